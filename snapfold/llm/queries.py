"""The registered queries of the operators, over whole tables with production parameters, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.llm import (
    bpe,
    chat,
    decontaminate,
    language,
    licenses,
    quality_rules,
    search,
    secrets,
    simhash,
    spelling,
    token_counts,
    toxicity,
    weak_labels,
)
from snapfold.llm.rows import table

UNIGRAM_FILE = public_tokenizers.path("piece_bpe_32k.model")
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def _sha(strings: Column) -> Column:
    return F.sha2(F.array_join(strings, ","), 256)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.with_language(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.with_passages(docs.select("doc_id", "text"), benchmark, "found")
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        _sha(F.array_sort(F.col("found.items").cast("array<string>"))).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
        F.array_join(F.transform("found.spans", lambda s: F.concat_ws(":", *(s[c].cast("string") for c in ("start", "end")))), ",").alias("spans"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return weak_labels.with_quality(docs, "quality").select("doc_id", "quality.*")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_tokens(bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), BPE_FILE))


def digest_tokens(coded: DataFrame, *more: str) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _sha(F.col("ids").cast("array<string>")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_counts(docs, UNIGRAM_FILE, "counted").select("doc_id", "counted.*")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("found", secrets.secret_spans(secrets.train(docs))("text")).select("doc_id", "found")
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        *(of(kind).alias(f"n_{kind}") for kind in secrets.KINDS),
        _sha(F.transform(base, line)).alias("base_sha256"),
        F.array_join(F.transform("found", line), ",").alias("spans"),
    )


def _remainder() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.with_toxicity(docs, labels, _remainder() != 2).select(
        "doc_id",
        (_remainder() == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"),
        "neighbours",
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.with_licences(table(spark, sf_dir, "documents").select("doc_id", "text"), "found")
    return found.select(
        "doc_id",
        F.array_join("found.sentences.id", ",").alias("sentences"),
        F.array_join("found.licences", ",").alias("licences"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.with_rules(docs, "rules").select("doc_id", F.col("rules").dropFields("failed").alias("rules")).select(
        "doc_id", "rules.*"
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), F.col("component").alias("component_id"))


#: Two turns whose texts are control strings, formatted with every table of conversations.
OWN_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame(OWN_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_trees(chat.chains(given.unionByName(own))))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.with_ranks(docs, table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.with_forms(spelling.word_counts(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_bpe": op4_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_secret_scan": op6_secret_scan,
    "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
    "op11_chat_format": op11_chat_format,
    "op12_lexical_search": op12_lexical_search,
    "op13_spelling_variants": op13_spelling_variants,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"[\x20\x09-\x0D]"
_UNBLANK = r"[^\x20\x09-\x0D]+"

_OP2_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS n FROM (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
      FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
x AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g))),
m AS (SELECT doc_id, item_id, k, x.n FROM x JOIN g USING (n, s)),
q AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM m),
h AS (SELECT doc_id, count(*) AS n_hit FROM q GROUP BY doc_id),
o AS (SELECT doc_id, p, length(w[p]) AS n, sum(length(gaps[p]) + coalesce(length(w[p - 1]), 0)) OVER (PARTITION BY doc_id ORDER BY p) AS a
      FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
            string_split_regex({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS gaps, unnest(range(1, len(w) + 1)) AS p
            FROM documents WHERE doc_id IN (SELECT doc_id FROM h))),
u AS (SELECT doc_id, min(a)::BIGINT AS a, max(a + n)::BIGINT AS b
      FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM o JOIN q USING (doc_id, p)) GROUP BY doc_id, island),
v AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM u GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN v USING (doc_id)"""

_OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_UNBLANK}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_UNBLANK}')) AS l FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
  SELECT doc_id, unnest(range(k, k + 3)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
  len(list_filter(w, lambda x: regexp_full_match(x, '[#*$%&|<>\-=_.!]+'))) AS n_bullets
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR n_upper > n_lower OR 4 * n_bullets > n_words
       OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM b"""

_OP12_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, t FROM (
  SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark)),
x AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d)
      WHERE t IN (SELECT t FROM i) GROUP BY doc_id, n, t),
f AS (SELECT t, count(*) AS df FROM x GROUP BY t),
p AS (SELECT item_id, doc_id, (floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
  * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS part
  FROM i JOIN x USING (t) JOIN f USING (t), s),
r AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM p GROUP BY item_id, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM r WHERE score > 0)
SELECT item_id, k::INT AS rank, doc_id, score FROM o WHERE k <= {search.TOP}"""


def _values(pairs) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs)


_OP8_SQL = rf"""
WITH known(plain, id) AS (VALUES {_values(licenses.known_sentences().items())}),
rules(licence, ids) AS (VALUES {_values(licenses.rule_sequences())}),
s AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS k
      FROM (SELECT doc_id, string_split_regex(text, '{licenses.SENTENCE_END}') AS p FROM documents)),
f AS (SELECT doc_id, string_agg(id, ',' ORDER BY k) AS sentences FROM s JOIN known ON known.plain =
  regexp_replace(regexp_replace(lower(s), '{licenses.NOT_PLAIN}', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') GROUP BY doc_id),
h AS (SELECT doc_id, licence, ids FROM f JOIN rules ON contains(';' || replace(sentences, ',', ';') || ';', ids)),
o AS (SELECT DISTINCT doc_id, licence FROM h WHERE NOT EXISTS (
  SELECT 1 FROM h AS b WHERE b.doc_id = h.doc_id AND length(b.ids) > length(h.ids) AND contains(b.ids, h.ids)))
SELECT doc_id, coalesce(sentences, '') AS sentences, coalesce(licences, '') AS licences FROM documents
LEFT JOIN f USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licences FROM o GROUP BY doc_id)
USING (doc_id)"""

#: Models, tokenizers and hashes of the others cannot be said in SQL; tests hold them against brute force or libraries.
ORACLES: dict[str, str] = {
    "op2_decontamination": _OP2_SQL,
    "op8_license_scan": _OP8_SQL,
    "op9_quality_rules": _OP9_SQL,
    "op12_lexical_search": _OP12_SQL,
}
