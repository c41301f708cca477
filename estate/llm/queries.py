"""The operators as registered queries: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estate.llm import (
    bpe,
    collocations,
    exact_dedup,
    fill_middle,
    line_dedup,
    near_dup,
    packing,
    quality_classifier,
    quality_rules,
    relative_parse,
    secrets,
    suffix_dedup,
    token_files,
)
from estate.llm.common import documents, table


VOCABULARY = "byte_bpe_50k.json"
# One more than the last id of that vocabulary, so no text can hold it: its own end of
# text, 50256, is also what "<|endoftext|>" spelt out is encoded to. Fits 16 bits.
END_OF_DOCUMENT = 50257


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels.where(~quality_classifier.held_out()))
    scored = quality_classifier.score(docs, model)
    return scored.select(
        "doc_id", quality_classifier.held_out().alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bpe.lengths(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return packing.pack(counted, F.col("n_tokens"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path(VOCABULARY)
    return bpe.digests(_encoded(spark, sf_dir), vocabulary, public_tokenizers.PATTERN)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_rules.trusted_rows(table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(documents(spark, sf_dir), trusted)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_files.write_token_files(_encoded(spark, sf_dir), END_OF_DOCUMENT)
    return token_files.token_counts(index, END_OF_DOCUMENT)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.line_dedup(documents(spark, sf_dir), counts=True)
    return clean.select("doc_id", "source", "n_lines", "n_dropped", F.col("text").alias("kept_text"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), words=2, percent=80)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = fill_middle.restore(fill_middle.fill_in_middle(documents(spark, sf_dir)))
    return samples.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = relative_parse.substring_dedup(documents(spark, sf_dir))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_packing, op3_bpe, op4_suffix_dedup, op5_quality_rules, op6_token_counts,
        op7_exact_dedup, op8_line_dedup, op9_secret_scan, op10_near_dup,
        op11_fill_middle, op12_phrase_mining, op13_substring_dedup,
    )
}

ORACLE = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op8_line_dedup": f"""
        WITH pages AS (
            SELECT row_number() OVER () AS page, doc_id, source, text, string_split(text, chr(10)) AS lines
            FROM documents),
        parts AS (
            SELECT page, doc_id, source, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM pages),
        totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
        often AS (
            SELECT p.source, p.line FROM parts p JOIN totals t ON p.source IS NOT DISTINCT FROM t.source
            WHERE trim(p.line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
            GROUP BY p.source, p.line, t.total
            HAVING count(DISTINCT page) >= {line_dedup.MIN_PAGES}
               AND count(DISTINCT page) > t.total * CAST({line_dedup.RATIO} AS DOUBLE)),
        clean AS (
            SELECT p.page, count(*) AS n_lines, count(o.line) AS n_dropped,
                   string_agg(p.line, chr(10) ORDER BY p.pos) FILTER (WHERE o.line IS NULL) AS kept_text
            FROM parts p LEFT JOIN often o ON p.source IS NOT DISTINCT FROM o.source AND p.line = o.line
            GROUP BY p.page)
        SELECT d.doc_id, d.source, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped,
               CASE WHEN d.text IS NOT NULL THEN coalesce(c.kept_text, '') END AS kept_text
        FROM pages d LEFT JOIN clean c ON d.page = c.page""",
    "op11_fill_middle": r"""
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
                   sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
            FROM documents),
        drawn AS (
            SELECT *, len(units) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
                   ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4
            FROM cut),
        placed AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS one, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS two,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                             OR h3 % 100 >= 100 THEN 'plain'
                        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn),
        pieces AS (
            SELECT *, coalesce(array_to_string(units[1:one], ''), '') AS p,
                   coalesce(array_to_string(units[one + 1:two], ''), '') AS m,
                   coalesce(array_to_string(units[two + 1:], ''), '') AS s
            FROM placed)
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM pieces""",
    "op12_phrase_mining": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS nr,
                   regexp_extract_all(unnest(regexp_split_to_array(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
            FROM documents WHERE text IS NOT NULL),
        starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS p FROM pieces),
        runs AS (
            SELECT lang, size, array_to_string(words[p:p + size - 1], ' ') AS phrase
            FROM starts, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE p + size - 1 <= len(words)),
        totals AS (SELECT lang, count(*) AS n FROM runs WHERE size = 1 GROUP BY lang),
        f AS (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY lang, size, phrase HAVING count(*) >= 30),
        found AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
        cuts AS (SELECT *, unnest(range(1, size)) AS k FROM found),
        parts AS (
            SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
            FROM cuts c
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.k], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.k + 1:], ' ')),
        lowest AS (
            SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pos FROM parts),
        inside AS (
            SELECT lang, array_to_string(words[b:b + m - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT *, unnest(range(1, size - m + 2)) AS b
                  FROM (SELECT *, unnest(range(2, size)) AS m FROM found))
            GROUP BY ALL),
        kept AS (
            SELECT w.* FROM lowest w LEFT JOIN inside i ON w.lang = i.lang AND w.phrase = i.phrase
            WHERE w.pos = 1 AND NOT coalesce(100 * i.longer >= 80 * w.a, false)),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
        FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= 2000""",
    "op13_substring_dedup": rf"""
        WITH parted AS (
            SELECT row_number() OVER () AS nr, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        starts AS (
            SELECT nr, doc_id, words, unnest(range(1, len(words) - {relative_parse.LEAST - 2})) AS p
            FROM parted WHERE len(words) >= {relative_parse.LEAST}),
        windows AS (
            SELECT nr, doc_id, p, md5(array_to_string(words[p:p + {relative_parse.LEAST - 1}], ' ')) AS name FROM starts),
        known AS (
            SELECT nr, p FROM (SELECT nr, p, doc_id, min(doc_id) OVER (PARTITION BY name) AS lo FROM windows)
            WHERE lo < doc_id),
        gone AS (
            SELECT nr, list_distinct(flatten(list(range(p, p + {relative_parse.LEAST})))) AS spots FROM known GROUP BY nr),
        marked AS (
            SELECT d.nr, d.doc_id, d.words, coalesce(g.spots, []) AS spots FROM parted d LEFT JOIN gone g ON d.nr = g.nr),
        each AS (SELECT nr, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM parted),
        cut AS (SELECT nr, unnest(spots) AS p FROM gone),
        rest AS (
            SELECT e.nr, string_agg(e.word, ' ' ORDER BY e.p) AS kept
            FROM each e LEFT JOIN cut c ON e.nr = c.nr AND e.p = c.p WHERE c.p IS NULL GROUP BY e.nr)
        SELECT m.doc_id, len(m.words) AS n_words, len(m.spots) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
        FROM marked m LEFT JOIN rest r ON m.nr = r.nr""",
}
