import random

from pyspark.sql import functions as F

from tekstara.operators import guess, joins, lexicon, measures, ranking, sequences, spelling
from tekstara.sources import readers, writers


def test_alignments():
    assert sequences.align_one(["Čia", "yra", "namas"], ["Čia", ",", "yra"]) == [0, 2, None]
    assert sequences.align_one(["Karas", "yra"], ["Karas", *"1234567890,.-", "yra"]) == [0, 14]
    assert sequences.align_two(["a", "b", "c", "d"], ["a", "x", "c", "d"]) == ([0, None, 2, 3], 1, 1)
    assert sequences.align_two(["a"], []) == ([None], 1, 0)


def test_chunks():
    assert sequences.chunks("Pirmas sakinys. Antras sakinys!", 20) == ["Pirmas sakinys.", " Antras sakinys!"]
    assert sequences.chunks("vienas du trys keturi", 12) == ["vienas du ", "trys keturi"]
    assert sequences.chunks("abcdefghijkl", 5) == ["abcde", "fghij", "kl"]
    assert sequences.chunks("") == []


def chosen_by_hand(rows, buckets, budget):
    """Ids by the rules, one decision after another."""
    share, used, out = budget / len(buckets), dict.fromkeys(buckets, 0), []
    for i, b, n in rows:
        if used[b] + n <= share:
            used[b] += n
            out.append(i)
    while sum(used.values()) < 0.985 * budget:
        before = len(out)
        for b in sorted(buckets, key=lambda x: (used[x], buckets.index(x))):
            room = min(budget - sum(used.values()), int(1.35 * share - used[b]))
            for i, c, n in rows:
                if c == b and i not in out and n <= room:
                    used[b] += n
                    out.append(i)
                    break
        if len(out) == before:
            break
    return out


def test_quota(spark):
    rng, want = random.Random(2), set()
    rows = [(g, i, rng.choice("abc"), rng.randint(1, 40)) for g in range(4) for i in range(30 if g else 3)]
    for g in range(4):
        want |= {(g, i) for i in chosen_by_hand([r[1:] for r in rows if r[0] == g], ["a", "b", "c"], 180)}
    df = spark.createDataFrame(rows, "g int, i int, b string, n long").repartition(3)
    got = sequences.quota_selected(df, "i", "b", "n", ["a", "b", "c"], 180, "g").collect()
    assert {(r["g"], r["i"]) for r in got} == want and len(got) == len(want)


def test_running_quota_over_ranges(spark):
    rows = [("x" if i % 3 else None, i * 7, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, n long").repartition(3)
    want = set()
    for k in ("x", None):
        total = 0
        for _, o, n in (r for r in rows if r[0] == k):
            if total >= 60:
                break
            total += n
            want.add((k, o))
    got = ranking.running_quota(df, "k", "n", 60, "o", width=100).collect()
    assert {(r["k"], r["o"]) for r in got} == want and len(got) == len(want)


def test_reach_with_a_cap(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 4), (3, 4), (4, 5), (5, 6)], "a long, b long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in sequences.reach(edges, start, 3).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)}
    assert {tuple(r) for r in sequences.reach(edges, start, 9, most=3).collect()} == {(1, 0), (2, 1), (3, 1)}


def test_tie_policies(spark):
    df = spark.createDataFrame([("k", "x", 2, 0), ("k", "y", 2, 1), ("k", "z", 1, 2), ("m", "x", 3, 0), ("n", "q", 0, 0)], "k string, v string, s int, o int")
    pick = lambda d: {r["k"]: r["v"] for r in d.collect()}
    assert pick(ranking.unique_top(df, ["k"], "v", "s", F.lit("d"))) == {"k": "d", "m": "d", "n": "d"}
    assert pick(ranking.first_max(df, ["k"], "v", "s", "o")) == {"k": "x", "m": "x"}
    assert pick(ranking.unanimous_top(df, ["k"], "v", "s")) == {"m": "x", "n": "q"}
    assert pick(ranking.keep_first(df.select("k", "v", "o"), ["k"], "o")) == {"k": "x", "m": "x", "n": "q"}
    assert pick(ranking.keep_last(df.select("k", "v", "o"), ["k"], "o")) == {"k": "z", "m": "x", "n": "q"}


def test_store(spark):
    old = spark.createDataFrame([("a", "old"), ("b", "old")], "word string, default_form string").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    new = spark.createDataFrame([("a", "new"), ("c", None)], "word string, default_form string")
    got = {r["word"]: r for r in lexicon.upsert(old, new, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got["a"]["default_form"] == "new" and got["b"]["default_form"] == "old"
    assert got["c"]["negative_until"].day == 2 and got["a"]["negative_until"] is None
    bad = spark.createDataFrame([("[{]",), ('[{"form":"x","info":"y","mi":[]}]',), ('[{"info":"y"}]',)], "j string")
    assert [r[0] is not None for r in bad.select(lexicon.variants(F.col("j"))).collect()] == [False, True, False]


def test_expiry(spark):
    rows = [("a", None, "ONE"), ("b", "2020-01-01", "ONE"), ("c", "2999-01-01", "ONE"), ("d", "no date", "ONE"), ("e", None, None)]
    df = spark.createDataFrame(rows, "key string, negative_until string, accent_type_title string")
    assert sorted(r["key"] for r in joins.live(df, F.lit("2024-01-01").cast("timestamp")).collect()) == ["a", "c"]


def test_patterns(spark):
    rows = [("x", "x", "x"), ("x", None, "y"), (None, None, None), (None, "y", None), ("x", "y", "y")]
    df = spark.createDataFrame(rows, "vdu string, joint string, dict string")
    assert [r[0] for r in df.select(measures.pattern(["vdu", "joint", "dict"])).collect()] == ["vdu+joint+dict", "vdu vs dict", "none", "joint-only", "joint+dict vs vdu"]


def test_firewall(spark):
    item = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, item.upper()), (2, "zero " + item), (3, "short"), (4, "one two three four five six seven")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "Short")], "item_id long, text string")
    assert sorted(tuple(r) for r in joins.firewall(docs, bench).collect()) == [(1, 1, "exact"), (2, 1, "shingle"), (3, 2, "exact")]


def test_guessers(spark):
    words = spark.createDataFrame([("namas", "a"), ("batas", "a"), ("upė", "b"), ("katė", "b"), ("nuo", None)], "w string, v string")
    table = guess.suffix_table(words.where("v is not null"), "w", "v")
    new = spark.createDataFrame([("ratas",), ("gėlė",), ("xyz",)], "w string")
    assert {r["w"]: r["v"] for r in guess.by_suffix(new, table, "w", "v").collect()} == {"ratas": "a", "gėlė": "b"}
    rules = guess.prefix_rules(words, "w", "v")
    assert {r["prefix"]: r["v"] for r in rules.collect()} == {"na": "a", "b": "a", "u": "b", "k": "b", "nu": None}


def test_spelling(spark):
    words = spark.createDataFrame([("žmogus", 500), ("diena", 300), ("aš", 100), ("ąs", 100), ("ačiū", 14413), ("ačiu", 83)], "form string, freq long")
    asked = ["zmogus", "žmogud", "deina", "as", "aciu", "qzxqzx", "diena", "Zzzz", "x"]
    q = spark.createDataFrame([(i, w, "ir" if w == "as" else None, None) for i, w in enumerate(asked)], "qid int, word string, prev string, next string")
    got = {r["word"]: r for r in spelling.suggest(q, words, spark.createDataFrame([("ir", "ąs", 10)], "w1 string, w2 string, n long")).collect()}
    assert got["zmogus"]["kind"] == "restore" and got["zmogus"]["corrections"] == ["žmogus"]
    assert got["žmogud"]["kind"] == "typo" and got["deina"]["corrections"] == ["diena"]
    assert got["as"]["corrections"] == ["ąs", "aš"] and got["as"]["autofix"] is None
    assert got["aciu"]["corrections"][0] == "ačiū" and got["aciu"]["autofix"] == "ačiū"
    assert [got[w]["kind"] for w in ("qzxqzx", "diena", "Zzzz", "x")] == ["unknown", "ok", "unknown", "ok"]


def test_conllu(spark):
    lines = ["# c", "1-2\tČia yra\t_\t_\t_\t_", "1\tČia\tčia\tADV\tRg\t_", "2\tyra\tbūti\tVERB\tV\tMood=Ind|Person=3", "2.1\tx\tx\tX\t_\t_", "3\t.\t.\tPUNCT\tT\t_"]
    df = spark.createDataFrame([("f", 0, "\n".join(lines))], "file string, sent long, value string")
    t = readers.conllu_tokens(df)
    assert [r["form"] for r in t.orderBy("id").collect()] == ["Čia", "yra", "."]
    assert writers.conllu_blocks(t).first()["value"].split("\n")[1].split("\t")[5] == "Mood=Ind|Person=3"


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nbad\n')
    assert readers.json_lines_within(spark, str(tmp_path / "a.jsonl"), "a int").count() == 2
    (tmp_path / "w.txt").write_text("žodis 5\nx y\nz 0\n")
    assert [tuple(r) for r in readers.word_list(spark, str(tmp_path / "w.txt")).collect()] == [("žodis", 5)]
    writers.append_new(spark.createDataFrame([(1,), (2,)], "k int"), str(tmp_path / "t"), "k")
    writers.append_new(spark.createDataFrame([(2,), (3,)], "k int"), str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    writers.replace(spark.createDataFrame([(9,)], "k int"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert readers.paragraphs_of("<nav><p>no</p></nav><p>one <b>x</b>&amp;</p><p>two") == ["one x&", "two"]


def test_intervals(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 5, 7), ("k", 9, 10), ("k", 1, 2)], "k string, a int, b int")
    assert sorted(tuple(r) for r in sequences.merge_intervals(df, "k", "a", "b").select("a", "b", "n").collect()) == [(0, 7, 3), (9, 10, 1)]


def test_spelling_spreads_words_not_queries(spark):
    words = spark.createDataFrame([("namas", 9)], "form string, freq long")
    q = spark.createDataFrame([(i, "namss", f"w{i}", None) for i in range(3)], "qid int, word string, prev string, next string")
    out = spelling.suggest(q, words)
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = [low for line, low in zip(plan, plan[1:], strict=False) if "Generate explode" in line and "deletion#" in line]
    assert len(below) >= 2 and not [low for low in below if "qid#" in low]
    assert [(r["kind"], r["corrections"]) for r in out.collect()] == [("typo", ["namas"])] * 3
