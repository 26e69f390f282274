"""Queries over lines, sentences and words of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines as ln
from .registry import WORDS, query, table, word_table

_N = r"len(regexp_extract_all({0}, '\p{{L}}[\p{{L}}\p{{M}}]*'))"
_FOLD = "translate(lower({0}), 'ąčęėįšųūž', 'aceeisuuz')"


def n_sql(c: str) -> str:
    return _N.format(c)


_BARE = r"regexp_replace(trim(x, chr(32)), '^:+|:+$', '', 'g')"
LINE_SQL = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), f AS (SELECT doc_id, x, regexp_matches(x, '^\s*(?:-+\s*)?[0-9]{{1,4}}(?:\s*-+)?\s*$') AS page, regexp_matches(lower(x), '^\s*(?:koordinatės|coordinates)\s*:') AS coordinate,
regexp_matches(x, '^\s*(?:[*#;:•·-]|[0-9]{{1,4}}\s*[\).:,-]|[IVXLCDMivxlcdm]{{1,8}}\s*[\).:-])') AS item, (regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}')) AS caps,
({_FOLD.format(_BARE)} IN ({", ".join(f"'{s}'" for s in ln.SECTIONS)}) OR {" OR ".join(f"starts_with({_FOLD.format(_BARE)}, '{s}')" for s in ln.SECTION_STARTS)} OR ({n_sql(_BARE)} <= 6 AND length({_BARE}) <= 80 AND NOT regexp_matches({_BARE}, '[.!?…;]$'))) AS header,
({" OR ".join(f"starts_with({_FOLD.format('x')}, '{s}')" for s in ln.EDITORIAL)} OR regexp_matches({_FOLD.format('x')}, '(?:^|[^0-9a-z_])(?:isbn|pdf|djvu)(?:$|[^0-9a-z_])') OR (regexp_matches({_FOLD.format('x')}, '(?:^|[^0-9a-z])(?:18|19|20)[0-9]{{2}}\s*m\.') AND {n_sql('x')} < 8)) AS editorial FROM l)"""


@query(f"WITH {LINE_SQL} SELECT doc_id, count(*)::BIGINT AS n, {', '.join(f'count(*) FILTER (WHERE {c})::BIGINT AS {c}' for c in ('page', 'coordinate', 'item', 'caps', 'header', 'editorial'))} FROM f GROUP BY doc_id")
def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    tests = {"page": ln.page_number(x), "coordinate": ln.coordinate(x), "item": ln.list_item(x), "caps": ln.all_caps(x), "header": ln.section_header(x), "editorial": ln.editorial(x)}
    flags = rows.select("doc_id", *[t.alias(c) for c, t in tests.items()])
    return flags.groupBy("doc_id").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in tests])


_MARKED = "[áàéèíìóòúùñÁÀÉÈÍÌÓÒÚÙÑ]"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS y FROM documents), o AS (SELECT doc_id, trim(regexp_replace(y, '\s+', ' ', 'g')) AS x FROM l)
SELECT doc_id, count(*) FILTER (WHERE x = '' OR regexp_matches(x, '^[0-9]{{1,3}}$') OR regexp_matches(x, '^[0-9]+[\s).,-]') OR NOT regexp_matches(x, '\p{{L}}') OR (NOT regexp_matches(x, '{_MARKED}') AND (regexp_matches(x, '\((?:g\.\s*)?\??[0-9]{{4}}(?:[–-][0-9]{{4}})?\)') OR {" OR ".join(rf"regexp_matches(x, '(?:^|[^\p{{L}}0-9_]){s}(?:$|[^\p{{L}}0-9_])')" for s in ln.SOURCES)}
 OR (regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}')) OR len(regexp_extract_all(x, '\p{{L}}')) <= 64)))::BIGINT AS noise FROM o GROUP BY doc_id""")
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return rows.groupBy("doc_id").agg(F.count_if(ln.noise(F.col("x"))).alias("noise"))


@query(f"""WITH t AS (SELECT doc_id, source || CASE WHEN doc_id % 7 = 0 THEN ': x' WHEN doc_id % 5 = 0 THEN ' (reikšmės)' ELSE '_a' END AS title FROM documents)
SELECT doc_id, NOT ({" OR ".join(f"contains(lower(trim(regexp_replace(replace(title, '_', ' '), '[ ]+', ' ', 'g'))), '{s}')" for s in ln.BLOCKED_TITLES)}) AND NOT contains(title, ':') AS keep FROM t""")
def kept_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    title = F.concat("source", F.when(d % 7 == 0, ": x").when(d % 5 == 0, " (reikšmės)").otherwise("_a"))
    return table(spark, sf_dir, "documents").select("doc_id", ln.keep_title(title).alias("keep"))


@query(f"""SELECT doc_id, count(*)::BIGINT AS paragraphs, count(*) FILTER (WHERE length(x) >= 40 AND NOT ({" OR ".join(f"starts_with(lower(x), '{s}')" for s in ln.BLOCKED_PARAGRAPHS)}))::BIGINT AS kept FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'Daugiau apie ' ELSE '' END || unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY doc_id""")
def kept_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    x = F.concat(F.when(F.col("doc_id") % 6 == 0, "Daugiau apie ").otherwise(""), "x")
    return rows.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if(ln.keep_paragraph(x)).alias("kept"))


_PROSE = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '(?i)(^|[^\p{{L}}0-9_])(ABBR)\.', '\1\2⸾', 'g'), '([.!?…]+["''”’)\]]*)\s+([NEXT])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: replace(trim(s, chr(32)), '⸾', '.')), lambda s: s <> '')""".replace("ABBR", "|".join(ln.ABBREVIATIONS)).replace("NEXT", ln.NEXT_STARTS.replace("'", "''"))


@query(f"WITH s AS (SELECT doc_id, unnest({_PROSE.format('text')}) AS s FROM documents) SELECT doc_id, count(*)::BIGINT AS sentences, count(*) FILTER (WHERE regexp_matches(s, '{_MARKED}'))::BIGINT AS kept, max(length(s))::INTEGER AS longest FROM s WHERE {n_sql('s')} >= 3 GROUP BY doc_id")
def prose_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(ln.prose_sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(ln.keep_sentence(F.col("s"))).alias("kept"), F.max(F.length("s")).alias("longest"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n+', chr(1), 'g'), '([.!?]+["'')\]]*)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(32))), lambda x: x <> '') AS s FROM documents) SELECT doc_id, len(s)::INTEGER AS sentences FROM s""")
def paragraph_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ln.paragraph_sentences(F.col("text"))).alias("sentences"))


@query(r"""WITH p AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\p{L}+(?:[-''’]\p{L}+)*|[.!?\n]+'), lambda p: CASE WHEN regexp_matches(p, '^[.!?\n]') THEN chr(1) ELSE p END) AS p FROM documents) SELECT doc_id, len(list_filter(string_split(array_to_string(p, ' '), chr(1)), lambda x: trim(x) <> ''))::INTEGER AS sentences FROM p""")
def gap_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ln.gap_sentences(F.col("text"))).alias("sentences"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+-[\p{L}\p{M}]+|[\p{L}\p{M}]+(?:[-''’][\p{L}\p{M}]+)*|[0-9]+|[^\s\p{L}\p{M}0-9]') AS t, regexp_extract_all(text, '\p{L}+(?:[-'']\p{L}+)*') AS h, regexp_extract_all(text, '[\p{L}\p{M}]+(?:[-''’][\p{L}\p{M}]+)*|[^\p{L}\p{M}]+') AS p FROM documents)
SELECT doc_id, len(t)::INTEGER AS tokens, len(list_filter(t, lambda x: regexp_matches(x, '\p{L}')))::INTEGER AS words, len(list_filter(t, lambda x: regexp_matches(x, '^[0-9]+-\p{L}')))::INTEGER AS numerals, len(h)::INTEGER AS hyphen_words, len(p)::INTEGER AS parts FROM t""")
def other_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", ln.surface(F.col("text")).alias("t"), ln.hyphen_words(F.col("text")).alias("h"), ln.preview_parts(F.col("text")).alias("p"))
    many = lambda test: F.size(F.filter("t", test))
    return t.select("doc_id", F.size("t").alias("tokens"), many(lambda x: x["is_word"]).alias("words"), many(lambda x: x["suffix"].isNotNull()).alias("numerals"), F.size("h").alias("hyphen_words"), F.size("p").alias("parts"))


@query(f"""WITH {WORDS}, q AS (SELECT word FROM w WHERE regexp_matches(word, '^[a-z]+$') AND length(word) BETWEEN 2 AND 5 AND freq >= 20), i AS (SELECT word, unnest(range(0, length(word) + 1)) AS i, length(word) AS n FROM q), l AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS c),
e AS (SELECT word, left(word, i) || substr(word, i + 2) AS e FROM i WHERE i < n UNION SELECT word, left(word, i) || substr(word, i + 2, 1) || substr(word, i + 1, 1) || substr(word, i + 3) FROM i WHERE i < n - 1 UNION SELECT word, left(word, i) || c || substr(word, i + 2) FROM i, l WHERE i < n UNION SELECT word, left(word, i) || c || substr(word, i + 1) FROM i, l)
SELECT word, count(*)::INTEGER AS edits FROM e WHERE e <> word GROUP BY word""")
def edit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = word_table(spark, sf_dir).where("word rlike '^[a-z]+$' and length(word) between 2 and 5 and freq >= 20")
    return q.select("word", F.size(ln.edits1(F.col("word"))).alias("edits"))


@query("SELECT event_id, (n > 0 AND (status = 'restore' OR (status = 'typo' AND unknown))) AS shown FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'restore' WHEN 1 THEN 'typo' WHEN 2 THEN 'ok' ELSE 'unknown' END AS status, event_id % 3 AS n, event_id % 5 = 0 AS unknown FROM events)")
def shown_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    status = F.when(i % 4 == 0, "restore").when(i % 4 == 1, "typo").when(i % 4 == 2, "ok").otherwise("unknown")
    return table(spark, sf_dir, "events").select("event_id", ln.show_correction(status, i % 3, i % 5 == 0).alias("shown"))


@query(f"WITH {WORDS} SELECT word, regexp_matches(regexp_replace(translate(word, 'áàãéèẽíìĩóòõúùũýỳỹñ', 'aaaeeeiiiooouuuyyyn'), '[a-pr-vyząčęėįšųūž]', '', 'g'), '\\p{{L}}') AS foreign_letters FROM w WHERE regexp_matches(word, '^\\p{{L}}+$')")
def foreign_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table(spark, sf_dir).where(F.col("word").rlike(r"^\p{L}+$")).select("word", ln.foreign_letters(F.col("word")).alias("foreign_letters"))


@query()
def extract_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(ln.extract_sentences(F.col("text"))).alias("n", "sentence"))
