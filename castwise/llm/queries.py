"""Registered queries of the text operators: each runs over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.llm import (
    chat,
    decontaminate,
    exact_dedup,
    fill_middle,
    html_extract,
    licenses,
    line_dedup,
    lm,
    mixing,
    near_dedup,
    resample,
    secrets,
    toxicity,
)
from castwise.llm.common import table
from castwise.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_mixing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of every document for the target weights of the label classes."""
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), labels, mixing.TARGETS)


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


@query("op3_license_scan", licenses.scan_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that whole documents or whole lines of them state."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query("op4_lm_scores")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the automaton learned from four fifths of them."""
    return lm.lm_scores(table(spark, sf_dir, "documents"))


@query("op5_minhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are similar by 80 of 100 or more."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the place of its best stretch."""
    return decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op8_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
    FROM d JOIN g USING (text)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest id stays."""
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_duplicates(docs, with_digest=True)


@query(
    "op9_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, u.i - 1 AS line, u.s AS words FROM (
        SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda s, i: {'i': i, 's': s})) AS u
        FROM documents WHERE text IS NOT NULL)),
    tokens AS (
      SELECT doc_id, line, list_distinct(list_filter(string_split_regex(lower(words), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS ws
      FROM lines),
    bags AS (
      SELECT list_sort(ws) AS ws, min(doc_id * 1000000 + line) AS spot FROM tokens WHERE len(ws) > 0 GROUP BY list_sort(ws)),
    df AS (SELECT w, count(*) AS c FROM (SELECT unnest(ws) AS w FROM bags) GROUP BY w),
    ranked AS (
      SELECT spot, len(ws) AS n, w, row_number() OVER (PARTITION BY spot ORDER BY c, w) AS pos
      FROM (SELECT spot, ws, unnest(ws) AS w FROM bags) JOIN df USING (w)),
    head AS (SELECT * FROM ranked WHERE pos <= n - ceil(0.8 * n - 1e-9) + 1),
    pairs AS (
      SELECT DISTINCT a.spot AS early, b.spot AS late FROM head a JOIN head b ON a.w = b.w AND a.spot < b.spot
      WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
    hit AS (
      SELECT DISTINCT late AS spot FROM (
        SELECT p.late, len(list_intersect(a.ws, b.ws)) AS k, len(a.ws) + len(b.ws) AS total
        FROM pairs p JOIN bags a ON a.spot = p.early JOIN bags b ON b.spot = p.late)
      WHERE k >= 0.8 * (total - k) - 1e-9),
    gone AS (
      SELECT t.doc_id, t.line FROM tokens t JOIN bags b ON list_sort(t.ws) = b.ws
      WHERE b.spot <> t.doc_id * 1000000 + t.line OR b.spot IN (SELECT spot FROM hit)),
    kept AS (
      SELECT doc_id, string_agg(words, chr(10) ORDER BY line) AS text, count(*) AS k
      FROM lines l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.line = l.line) GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
      CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::INTEGER AS n_lines,
      CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k, 0) END::INTEGER AS n_removed
    FROM documents d LEFT JOIN kept USING (doc_id)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text less the repeated lines."""
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated score for every document."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


CONTROL = "<|im_end|><|im_start|>assistant ok"  # a conversation whose texts are made of marks


@query(
    "op11_chat_format",
    r"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
      UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
    sized AS (
      SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_start|>' || '<|im_end|>') + 2
        + length(regexp_replace(replace(replace(role, '~', '~0'), chr(10), '~1'), '<(\\*)\|', '<\\\1|', 'g')) AS chars FROM rows)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      sum(chars)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and read back from the output."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    turns = chat.canonical_turns(chat.records_of_rows(rows))
    return chat.chat_digests(chat.formatted(turns))


@query(
    "op12_fill_middle",
    """
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    h AS (
      SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
        ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
    c AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
      sha256(text) AS restored_sha256
    FROM p
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three and written in its form."""
    return fill_middle.fill_digests(table(spark, sf_dir, "documents"))


@query(
    "op13_importance_resampling",
    r"""
    WITH texts AS (
      SELECT doc_id AS id, 0 AS kind, coalesce(text, '') AS text FROM documents UNION ALL SELECT item_id, 1, coalesce(text, '') FROM benchmark),
    words AS (
      SELECT id, kind, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
    runs AS (
      SELECT id, kind, len(w) AS n, unnest(list_concat(w, list_concat(
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS f FROM words),
    counted AS (SELECT f, count(*) FILTER (WHERE kind = 0) AS s, count(*) FILTER (WHERE kind = 1) AS t FROM runs GROUP BY f),
    -- a byte to be mixed in, then eight steps of one bit (-1); every code point is one to four bytes
    steps AS (
      SELECT f, s, t, flatten(list_transform(string_split(f, ''), lambda ch:
        CASE WHEN unicode(ch) < 128 THEN [unicode(ch), -1, -1, -1, -1, -1, -1, -1, -1]
          WHEN unicode(ch) < 2048 THEN [192 + (unicode(ch) >> 6), -1, -1, -1, -1, -1, -1, -1, -1, 128 + (unicode(ch) & 63), -1, -1, -1, -1, -1, -1, -1, -1]
          WHEN unicode(ch) < 65536 THEN [224 + (unicode(ch) >> 12), -1, -1, -1, -1, -1, -1, -1, -1, 128 + ((unicode(ch) >> 6) & 63), -1, -1, -1, -1, -1, -1, -1, -1,
            128 + (unicode(ch) & 63), -1, -1, -1, -1, -1, -1, -1, -1]
          ELSE [240 + (unicode(ch) >> 18), -1, -1, -1, -1, -1, -1, -1, -1, 128 + ((unicode(ch) >> 12) & 63), -1, -1, -1, -1, -1, -1, -1, -1,
            128 + ((unicode(ch) >> 6) & 63), -1, -1, -1, -1, -1, -1, -1, -1, 128 + (unicode(ch) & 63), -1, -1, -1, -1, -1, -1, -1, -1] END)) AS x
      FROM counted),
    hashed AS (
      SELECT f, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, x::BIGINT[]),
        lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 10000 AS bucket FROM steps),
    sums AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket),
    gains AS (
      SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM sums) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain FROM sums),
    weights AS (SELECT id, sum(gain)::BIGINT AS weight FROM runs JOIN hashed USING (f) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY id),
    scores AS (
      SELECT id AS doc_id, len(w) AS n, (greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
      FROM words LEFT JOIN weights USING (id) WHERE kind = 0),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scores WHERE n >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * (SELECT count(*) FROM ranked) // 100 THEN r END AS rank FROM scores LEFT JOIN ranked USING (doc_id)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of a hundred documents, drawn towards the benchmark's distribution."""
    return resample.importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
