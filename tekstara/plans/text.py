"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import ABBREVIATIONS, all_caps, deletes1, fold_ascii, is_clean_form, list_heavy, per_thousand, sentences, shingles, tokens, word_class
from ..operators.joins import firewall, normalized
from ..operators.measures import distribution, histogram
from ..operators.ranking import hash_split, keep_first, running_quota, top_k, vocabulary
from ..operators.sequences import chunked, quota_selected
from ..operators.spelling import bigrams
from ..sources.readers import html_paragraphs
from .accent import parts
from .registry import TOKENS, WORDS, doc_tokens, doc_words, query, table, word_table


@query(f"WITH {TOKENS} SELECT token, count(*)::BIGINT AS freq FROM tok GROUP BY token")
def token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_tokens(spark, sf_dir).groupBy("token").agg(F.count("*").alias("freq"))


@query(f"WITH {WORDS} SELECT * FROM w")
def word_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table(spark, sf_dir)


_FIREWALL = r"""
norm AS (SELECT doc_id, source, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t, regexp_extract_all(lower(text), '[\p{L}\p{M}]+') AS w FROM documents),
bnorm AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t, regexp_extract_all(lower(text), '[\p{L}\p{M}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 8], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS i FROM norm)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i + 1:i + 8], ' ') AS s FROM (SELECT item_id, w, unnest(range(0, len(w) - 7)) AS i FROM bnorm)),
hits AS (SELECT doc_id, item_id, min(reason) AS reason FROM (
  SELECT doc_id, item_id, 'exact' AS reason FROM norm JOIN bnorm USING (t) UNION ALL SELECT DISTINCT doc_id, item_id, 'shingle' FROM ds JOIN bs USING (s)) GROUP BY ALL)
"""


@query(f"WITH {_FIREWALL} SELECT * FROM hits")
def decontam_shingle8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return firewall(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"WITH {_FIREWALL} SELECT source, reason, count(DISTINCT doc_id)::BIGINT AS docs, count(*)::BIGINT AS pairs FROM hits JOIN norm USING (doc_id) GROUP BY ALL")
def decontam_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = firewall(docs, table(spark, sf_dir, "benchmark"))
    return hits.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "reason").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("pairs"))


@query(r"SELECT doc_id FROM documents WHERE trim(regexp_replace(lower(text), '\s+', ' ', 'g')) NOT IN (SELECT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) FROM benchmark)")
def decontam_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", normalized(F.col("text")).alias("t"))
    return docs.join(table(spark, sf_dir, "benchmark").select(normalized(F.col("text")).alias("t")), "t", "left_anti").select("doc_id")


#: The bound of the table of pairs, which is its own feature.
MAX_BIGRAMS = 220_000


@query(f"""WITH {TOKENS}, p AS (SELECT lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS w1, token AS w2 FROM tok)
SELECT w1, w2, count(*)::BIGINT AS n FROM p WHERE w1 IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, w1, w2 LIMIT {MAX_BIGRAMS}""")
def bigram_counts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bigrams(doc_words(spark, sf_dir)).orderBy(F.desc("n"), "w1", "w2").limit(MAX_BIGRAMS)


@query(f"""WITH {WORDS}, v AS (SELECT word FROM w WHERE freq >= 5), t AS (SELECT doc_id, pos, CASE WHEN v.word IS NOT NULL THEN token END AS token FROM tok LEFT JOIN v ON v.word = tok.token),
p AS (SELECT lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS w1, token AS w2 FROM t)
SELECT w1, w2, count(*)::BIGINT AS n FROM p WHERE w1 IS NOT NULL AND w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""")
def bigrams_in_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = word_table(spark, sf_dir).where("freq >= 5").select(F.col("word").alias("token"))
    return bigrams(doc_words(spark, sf_dir), vocabulary=known)


@query(f"WITH {WORDS} SELECT translate(word, 'ąčęėįšųūž', 'aceeisuuz') AS fold, count(*)::BIGINT AS forms, sum(freq)::BIGINT AS freq FROM w GROUP BY 1")
def fold_ascii_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table(spark, sf_dir).groupBy(fold_ascii("word").alias("fold")).agg(F.count("*").alias("forms"), F.sum("freq").alias("freq"))


@query(f"""WITH {WORDS}, d AS (SELECT DISTINCT word, substr(word, 1, i) || substr(word, i + 2) AS deletion FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w WHERE freq >= 5))
SELECT deletion, count(*)::BIGINT AS words FROM d GROUP BY deletion""")
def delete1_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_table(spark, sf_dir).where("freq >= 5")
    return words.select(F.explode(deletes1("word")).alias("deletion")).groupBy("deletion").agg(F.count("*").alias("words"))


@query(r"SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents) GROUP BY t")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    # keyed by two hashes of the text, not by the text: the shuffle carries 24 bytes a row
    docs = table(spark, sf_dir, "documents").select("doc_id", normalized(F.col("text")).alias("t")).select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("""SELECT doc_id, source, n_chars FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM documents) WHERE s - n_chars < 40000""")
def sample_running_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_quota(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars", 40000, "doc_id")


@query("""SELECT lang, part, count(*)::BIGINT AS docs FROM (SELECT lang, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR || 's1'), 1, 6))::BIGINT % 100 < 5 THEN 'held' ELSE 'train' END AS part FROM documents) GROUP BY ALL""")
def hash_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_split(table(spark, sf_dir, "documents"), "doc_id", 5, "s1").groupBy("lang", "part").agg(F.count("*").alias("docs"))


@query("SELECT source, sum(n_chars)::BIGINT AS n, sum(n_chars)::DOUBLE / (SELECT sum(n_chars) FROM documents) AS share FROM documents GROUP BY source")
def bucket_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution(table(spark, sf_dir, "documents"), "source", "n_chars")


_BOUNDS = [0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 20.0]
_CASES = " ".join(f"WHEN d < {b} THEN {i}" for i, b in enumerate(_BOUNDS))


@query(rf"""SELECT (CASE {_CASES} ELSE {len(_BOUNDS)} END)::INTEGER AS bin, count(*)::BIGINT AS docs FROM (
SELECT CASE WHEN l > 0 THEN 100.0::DOUBLE * m / l ELSE 0 END AS d FROM (SELECT len(regexp_extract_all(text, '[^\x00-\x7f]')) AS m, len(regexp_extract_all(text, '\p{{L}}')) AS l FROM documents)) GROUP BY 1""")
def density_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks, letters = F.regexp_count("text", F.lit(r"[^\x00-\x7f]")), F.regexp_count("text", F.lit(r"\p{L}"))
    density = F.coalesce(F.try_divide(F.lit(100.0) * marks, letters), F.lit(0.0))
    return table(spark, sf_dir, "documents").select(histogram(density, _BOUNDS).alias("bin")).groupBy("bin").agg(F.count("*").alias("docs"))


_STOP = "der die und von zu das mit sich auf einer nicht ist".split()


@query(f"""WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+') AS w, len(regexp_extract_all(lower(text), '[äöüß]')) AS m FROM documents)
SELECT doc_id, lang, coalesce(len(list_filter(w, lambda x: x IN ({", ".join(f"'{s}'" for s in _STOP)})))::DOUBLE / nullif(len(w), 0), 0) AS stop_share, m::INTEGER AS letters,
(coalesce(len(list_filter(w, lambda x: x IN ({", ".join(f"'{s}'" for s in _STOP)})))::DOUBLE / nullif(len(w), 0), 0) >= 0.025 OR m >= 8) AS looks FROM t""")
def lang_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", "lang", tokens(F.lower("text")).alias("w"), F.regexp_count(F.lower("text"), F.lit("[äöüß]")).alias("letters"))
    share = F.coalesce(F.try_divide(F.size(F.filter("w", lambda x: x.isin(_STOP))).cast("double"), F.size("w")), F.lit(0.0))
    return t.select("doc_id", "lang", share.alias("stop_share"), "letters").withColumn("looks", (F.col("stop_share") >= 0.025) | (F.col("letters") >= 8))


@query(r"""WITH r AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) AS n, len(regexp_extract_all(text, '[éèêç]')) AS a, len(regexp_extract_all(text, '[äöüß]')) AS b, len(regexp_extract_all(text, '[ñóí]')) AS c FROM documents),
s AS (SELECT doc_id, coalesce(a * 1000.0::DOUBLE / nullif(n, 0), 0) AS french, coalesce(b * 1000.0::DOUBLE / nullif(n, 0), 0) AS german, coalesce(c * 1000.0::DOUBLE / nullif(n, 0), 0) AS spanish FROM r)
SELECT *, array_to_string(list_filter([CASE WHEN french > 200 THEN 'french' END, CASE WHEN german > 100 THEN 'german' END, CASE WHEN spanish > 100 THEN 'spanish' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""")
def orthography_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(tokens(F.lower("text")))
    rates = table(spark, sf_dir, "documents").select("doc_id", per_thousand("[éèêç]", "text", n).alias("french"), per_thousand("[äöüß]", "text", n).alias("german"), per_thousand("[ñóí]", "text", n).alias("spanish"))
    flags = [F.when(F.col(c) > t, F.lit(c)) for c, t in (("french", 200), ("german", 100), ("spanish", 100))]
    return rates.withColumn("reasons", F.array_join(F.filter(F.array(*flags), lambda x: x.isNotNull()), ","))


@query(r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
s AS (SELECT doc_id, len(l)::BIGINT AS lines, coalesce(len(list_filter(l, lambda x: length(x) < 60))::DOUBLE / nullif(len(l), 0), 0) AS short_share, coalesce(len(list_filter(l, lambda x: regexp_matches(x, '[.!?]\s*$')))::DOUBLE / nullif(len(l), 0), 0) AS ended_share FROM l)
SELECT *, CASE WHEN lines >= 4 AND short_share > 0.7 AND ended_share < 0.5 THEN 'verse' WHEN ended_share >= 0.5 THEN 'prose' ELSE 'mixed' END AS genre FROM s""")
def genre_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    share = lambda test: F.coalesce(F.try_divide(F.size(F.filter("l", test)).cast("double"), F.size("l")), F.lit(0.0))
    s = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    s = s.select("doc_id", F.size("l").cast("long").alias("lines"), share(lambda x: F.length(x) < 60).alias("short_share"), share(lambda x: x.rlike(r"[.!?]\s*$")).alias("ended_share"))
    verse = (F.col("lines") >= 4) & (F.col("short_share") > 0.7) & (F.col("ended_share") < 0.5)
    return s.withColumn("genre", F.when(verse, "verse").when(F.col("ended_share") >= 0.5, "prose").otherwise("mixed"))


@query(f"WITH {WORDS} SELECT word, freq FROM w WHERE length(word) BETWEEN 2 AND 32 AND regexp_matches(word, '^\\p{{L}}+(?:-\\p{{L}}+)*$') AND freq >= 2")
def clean_wordlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table(spark, sf_dir).where(is_clean_form("word") & (F.col("freq") >= 2)).select("word", "freq")


@query(r"""SELECT doc_id, len(s)::INTEGER AS sentences, list_max(list_transform(s, lambda x: length(x)))::INTEGER AS longest FROM (
SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…]+["”’»)]*)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).alias("longest"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)
SELECT doc_id, (len(l) >= 10 AND len(list_filter(l, lambda x: regexp_matches(x, '^\s*(?:[-*•]|\d+[.)])') OR len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) < 3)) > 0.4 * len(l)) AS list_heavy FROM l""")
def list_heavy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", list_heavy("text").alias("list_heavy"))


@query(r"""SELECT doc_id, count(*)::BIGINT AS caps_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}') GROUP BY doc_id""")
def all_caps_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return lines.where(all_caps("x")).groupBy("doc_id").agg(F.count("*").alias("caps_lines"))


@query(rf"""WITH p AS (SELECT lang, unnest(list_zip(t, t[2:])) AS x FROM (SELECT lang, regexp_extract_all(text, '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}]+') AS t FROM documents)),
w AS (SELECT lang, x[1] AS token, coalesce(left(x[2], 1), '') AS after FROM p WHERE regexp_matches(x[1], '^[\p{{L}}\p{{M}}]'))
SELECT lang, CASE WHEN after = '.' AND (length(token) = 1 OR lower(token) IN ({", ".join(f"'{x}'" for x in ABBREVIATIONS)})) THEN 'ABBREVIATION' WHEN regexp_matches(token, '^[IVXLCDM]+$') THEN 'NUMERAL'
WHEN regexp_matches(token, '^[A-Za-zĄČĘĖĮŠŲŪŽąčęėįšųūž]+$') THEN 'WORD' ELSE 'FOREIGN' END AS class, count(*)::BIGINT AS n FROM w GROUP BY ALL""")
def word_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all tokens as they are written, each with the character that follows it."""
    words = parts(table(spark, sf_dir, "documents"), "lang").where("class <> 'SEPARATOR'")
    return words.groupBy("lang", "class").agg(F.count("*").alias("n"))


@query("SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS id FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def label_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(table(spark, sf_dir, "documents"), "lang")


@query(f"WITH {TOKENS} SELECT lang, token, n, rank FROM (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY n DESC, token))::INTEGER AS rank FROM (SELECT lang, token, count(*)::BIGINT AS n FROM tok GROUP BY lang, token)) WHERE rank <= 20")
def top_tokens_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = doc_tokens(spark, sf_dir).groupBy("lang", "token").agg(F.count("*").alias("n"))
    return top_k(counts, ["lang"], 20, F.desc("n"), F.col("token"))


@query(f"""WITH {WORDS}, t AS (SELECT freq, row_number() OVER (ORDER BY freq DESC, word) AS r FROM w)
SELECT k::INTEGER AS k, (sum(freq) FILTER (WHERE r <= k))::DOUBLE / sum(freq) AS covered FROM t, (SELECT unnest([10, 100, 1000]) AS k) GROUP BY k""")
def top_script_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_table(spark, sf_dir).select("word", "freq")
    total = words.agg(F.sum("freq")).first()[0]
    top = words.orderBy(F.desc("freq"), "word").limit(1000).select("freq", F.row_number().over(W.orderBy(F.desc("freq"), "word")).alias("r"))
    ks = [10, 100, 1000]
    sums = top.agg(*[F.sum(F.when(F.col("r") <= k, F.col("freq"))).alias(f"k{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"k{k}") / F.lit(total)).alias("covered")) for k in ks])
    return sums.select(F.inline(rows))


@query(r"""SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY conv_id, turn) AS r FROM conversations) WHERE r = 1""")
def distinct_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").withColumn("k", F.sha2(F.lower("text").cast("binary"), 256))
    return keep_first(turns, ["k"], "conv_id", "turn").select("conv_id", "turn", "text")


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}]+') AS w FROM documents) SELECT doc_id, count(DISTINCT array_to_string(w[i + 1:i + 8], ' '))::BIGINT AS shingles
FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS i FROM d) GROUP BY doc_id""")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", tokens(F.lower("text")).alias("w")).where(F.size("w") >= 8)
    return w.select("doc_id", F.explode(shingles(F.col("w"), 8)).alias("s")).groupBy("doc_id").agg(F.countDistinct(F.xxhash64("s")).alias("shingles"))


@query()
def html_paragraph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paragraphs(table(spark, sf_dir, "pages"))


@query(r"""WITH RECURSIVE c(doc_id, chunk, text, rest) AS (SELECT doc_id, -1, NULL::VARCHAR, text FROM documents UNION ALL SELECT doc_id, chunk + 1, left(rest, n), substr(rest, n + 1) FROM (SELECT *, CASE WHEN length(rest) <= 4500 THEN length(rest)
ELSE coalesce(nullif(length(regexp_extract(left(rest, 4500), '(?s)^.*[.!?\n]')), 0), nullif(length(regexp_extract(left(rest, 4500), '(?s)^.* ')), 0), 4500) END AS n FROM c WHERE rest <> ''))
SELECT doc_id, chunk::INTEGER AS chunk, text FROM c WHERE chunk >= 0""")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(table(spark, sf_dir, "documents"), "doc_id")


@query()
def greedy_bucket_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang is not null and n_chars is not null").select("source", "doc_id", "lang", "n_chars")
    return quota_selected(docs, "doc_id", "lang", "n_chars", ["de", "en", "es", "fr"], 60000, "source")
