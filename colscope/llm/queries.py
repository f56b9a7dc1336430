"""Queries of the dealt operators with production parameters, each over its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from colscope.llm import divergence, jaccard, language, licences, manifest, mixing, packing, passages, pieces, quality, rules, suffixes, vafile
from colscope.llm.registry import QUERIES, SQL, query  # noqa: F401
from colscope.llm.scratch import table


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed public tokenizer files have ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_mix_sources")
def op1_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query(
    "op6_quality_rules",
    r"""
    WITH w AS (
        SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ), g AS (
        SELECT id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
    ), twice AS (
        SELECT id, g FROM g GROUP BY id, g HAVING count(*) > 1
    ), covered AS (
        SELECT id, count(DISTINCT p) AS n
        FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN twice USING (id, g)) GROUP BY id
    ), lines AS (
        SELECT id, count(*) - count(DISTINCT line) AS n
        FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM w)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id
    ), f AS (
        SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
               CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
               CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
               CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
               CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
        FROM w LEFT JOIN lines USING (id) LEFT JOIN covered USING (id)
    ), v AS (
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               length(regexp_replace(text, '\P{L}+', '', 'g')) AS letters,
               length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS capitals
        FROM f
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > n_words
                OR 2 * n_dup_lines > len(string_split(text, chr(10))) OR 10 * n_repeat_words > 3 * n_words
                OR 2 * letters < word_chars OR 2 * capitals > letters
                OR 10 * len(regexp_extract_all(text, '!')) > n_words
                OR 10 * len(regexp_extract_all(text, '\p{Nd}')) > 3 * word_chars) AS kept
    FROM v
    """,
)
def op6_quality_rules(spark, sf_dir):
    found = rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *rules.FIGURES, "base_failed", "kept")


@query(
    "op2_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
        WHERE q.vec_id % 100 = 0
    ), r AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
)
def op2_exact_top_k(spark, sf_dir):
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query("op4_sentencepiece")
def op4_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())


@query("op7_quality_classifier")
def op7_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = language.fit(docs, model_path())
    asked = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "text")
    return language.predict(asked, model)


@query(
    "op9_ngram_jaccard",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS shingle
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
        UNION ALL
        SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) IN (1, 2)
    ), n AS (
        SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), p AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
        FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
    ), l AS (
        SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)
    ), e AS (
        SELECT x, y FROM l UNION ALL SELECT y, x FROM l
    ), r AS (
        SELECT x AS node, y AS other FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.other = e.x
    )
    SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles,
           CAST(least(w.doc_id, coalesce(min(r.other), w.doc_id)) AS BIGINT) AS component_id
    FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.node = w.doc_id GROUP BY w.doc_id
    """,
)
def op9_ngram_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, sf_dir):
    return suffixes.cut(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


@query("op8_license_scan")
def op8_license_scan(spark, sf_dir):
    return licences.documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_near_passages")
def op3_near_passages(spark, sf_dir):
    return passages.near_passages(table(spark, sf_dir, "documents"))


@query("op13_pack_sequences")
def op13_pack_sequences(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"), model_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query(
    "op11_source_divergence",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents
    ), o AS (
        SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
    ), k AS (
        SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 10
    ), l AS (
        SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang
    ), c AS (
        SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL
    ), g AS (
        SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total
        FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source
    ), p AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
               1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v) AS p,
               1 + CAST(1000000000 AS HUGEINT) * (k.n + 2) // (l.total + 2 * l.v) AS q
        FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ), f AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), r AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
    ), s AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r
    )
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM s WHERE part = 'pair' OR rank <= 10
    """,
)
def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@query(
    "op12_merkle_manifest",
    """
    WITH RECURSIVE t AS (
        SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
            lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
    ), d AS (
        SELECT row_number() OVER () AS id, doc_id, text, CASE WHEN source IS NULL THEN '' ELSE '.' || source END AS tree,
               list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
                   lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')) AS head,
               xor(4294967295, list_reduce(
                   list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                   lambda c, x: xor(t[CAST(xor(c, x) % 256 AS INTEGER) + 1], c // 256))) AS crc
        FROM documents, t
    ), l AS (
        SELECT id, doc_id, tree, sha256(array_to_string(head, '') || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
               CASE WHEN crc % 5 = 0 THEN sha256(array_to_string(head, '') || coalesce(octet_length(encode(text)) || ':' ||
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
        FROM d
    ), p AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS cnt FROM l
    ), n AS (
        SELECT 0 AS level, tree, pos, cnt, leaf AS hash FROM p
        UNION ALL
        SELECT level + 1, tree, pos // 16, (cnt + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM n WHERE cnt > 1 GROUP BY level, tree, pos // 16, cnt
    ), r AS (
        SELECT tree, hash AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS cnt FROM n WHERE cnt = 1
    ), m AS (
        SELECT 0 AS level, pos, cnt, subroot AS hash FROM r
        UNION ALL
        SELECT level + 1, pos // 16, (cnt + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM m WHERE cnt > 1 GROUP BY level, pos // 16, cnt
    ), s AS (
        SELECT a.level, a.tree, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
               coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
        FROM (SELECT * FROM n UNION ALL SELECT level, NULL, pos, cnt, hash FROM m) a
        JOIN (SELECT * FROM n UNION ALL SELECT level, NULL, pos, cnt, hash FROM m) b
          ON a.level = b.level AND a.tree IS NOT DISTINCT FROM b.tree AND a.pos // 16 = b.pos // 16 AND a.cnt > 1
        GROUP BY a.level, a.tree, a.pos
    ), f AS (
        SELECT id, tree, 0 AS level, pos, coalesce(other, leaf) AS hash, '' AS proof FROM p
        UNION ALL
        SELECT f.id, f.tree, f.level + 1, f.pos // 16, sha256(s.l || f.hash || s.r), f.proof || s.l || s.r
        FROM f JOIN s ON s.tree = f.tree AND s.level = f.level AND s.pos = f.pos
    ), g AS (
        SELECT id, f.tree, 0 AS level, r.pos, hash, proof FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level DESC) AS k FROM f) f JOIN r ON r.tree = f.tree WHERE k = 1
        UNION ALL
        SELECT g.id, g.tree, g.level + 1, g.pos // 16, sha256(s.l || g.hash || s.r), g.proof || s.l || s.r
        FROM g JOIN s ON s.tree IS NULL AND s.level = g.level AND s.pos = g.pos
    ), e AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level DESC) AS k FROM g) WHERE k = 1
    )
    SELECT doc_id, leaf, subroot, root.hash AS root, sha256(proof) AS proof_sha256, e.hash AS folded_root, e.hash = root.hash AS verified
    FROM l JOIN e USING (id) JOIN r ON r.tree = l.tree JOIN (SELECT hash FROM m WHERE cnt = 1) root ON true
    """,
)
def op12_merkle_manifest(spark, sf_dir):
    return manifest.document_manifest(table(spark, sf_dir, "documents"))
