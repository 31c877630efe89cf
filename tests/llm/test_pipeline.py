"""The stages against plain versions on one small input."""

import random

import corpus_pipeline as P
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, tmp_path):
    r = random.Random(8)
    make = lambda n: " ".join(r.choice("bcdfghklm") + r.choice("aeiou") + r.choice("nrst") for _ in range(n))
    passage = make(60)
    texts = [make(r.randint(5, 200)) for _ in range(40)]
    texts += [texts[0], texts[0].replace(" ", "\n"), texts[1] + " tail", None, "", "123 !!", passage + " " + make(30), make(40) + " " + passage]
    rows = [(i, t, "en" if i % 3 else "de", "s", len(t or "")) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


def stage(spark, name, df, tmp_path):
    out = dict(P.STAGES)[name](spark, df, str(tmp_path))
    out.write.mode("overwrite").parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_stages(spark, tmp_path):
    df = docs(spark, tmp_path)
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
    one = stage(spark, "language_id", df, tmp_path)
    assert set(ids(df)) - set(ids(one)) >= {43, 44, 45} and len(ids(one)) >= 40
    two = stage(spark, "exact_dedup", df, tmp_path)
    assert ids(two) == sorted(set(range(48)) - {40, 41, 44})
    three = stage(spark, "near_dedup", two, tmp_path)
    assert set(ids(two)) - set(ids(three)) <= {42}
    four = stage(spark, "suffix_dedup", three, tmp_path)
    assert four.columns == df.columns
    text = {r["doc_id"]: r for r in four.collect()}
    passage_words = {r["doc_id"]: r for r in three.collect()}[46].text.split()[:60]
    assert text[46].text.split()[:60] == passage_words
    assert len(text[47].text.split()) == 40 and text[47].n_chars == len(text[47].text)
    assert all(text[i].text == r.text for i, r in {r["doc_id"]: r for r in three.collect()}.items() if i in text and i != 47)
    five = dict(P.STAGES)["packing"](spark, four, str(tmp_path))
    assert set(r[0] for r in five.select("doc_id").distinct().collect()) == set(ids(four))


def test_language_stage_looks_at_the_text_alone(spark):
    r = random.Random(4)
    make = lambda a, b, n: " ".join("".join(r.choice(a) + r.choice(b) for _ in range(r.randint(1, 3))) for _ in range(n))
    en, de = (lambda n: make("bcdfg", "aei", n)), (lambda n: make("klmnp", "ouy", n))
    noise = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))
    for many, few in ((90, 10), (50, 50), (10, 90)):
        rows = [(i, en(30), "en") for i in range(many)] + [(1000 + i, de(30), "de") for i in range(few)]
        rows += [(2000, "\u0436\u0434\u0430 \u043c\u0438\u0440 " * 40, None), (2001, "\u0436\u0434\u0430", None), (2002, noise(200), None), (2003, noise(3), None), (2004, "bade cafi", None), (2005, "kuly", None)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        kept = {x["doc_id"] for x in P.language_id(spark, df, "").collect()}
        assert kept == {i for i, *_ in rows} - {2000, 2001, 2002, 2003}, (many, few)


def test_run(spark, tmp_path):
    docs(spark, tmp_path)
    out = P.run(spark, str(tmp_path))
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_stages_on_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    for name, f in P.STAGES:
        assert f(spark, df, "").count() == 0, name


def test_language_stage_goes_by_the_predicted_language(spark):
    """Words known from one language, whose n-grams are usual in the other only: what the method predicts decides."""
    from stillwater.llm.language_id import least_explained, predict, train

    r = random.Random(9)
    make = lambda a, b, n: " ".join("".join(r.choice(a) + r.choice(b) for _ in range(3)) for _ in range(n))
    rows = [(i, make("bcdfg", "aei", 60), "en") for i in range(60)] + [(1000 + i, make("klmnp", "ouy", 60) + " bacedi" * 40, "de") for i in range(60)]
    rows += [(2000, "bacedi " * 30, None), (2001, "", None), (2002, make("bcdfg", "aei", 40), None), (2003, "zzq " * 50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = df.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    model = train(learn, "text", "lang", "doc_id")
    least = dict(zip(model.langs, least_explained(learn, model, "text", "lang", "doc_id")))
    want = {x["doc_id"] for x in predict(df, model, explained=True).collect() if x["lang_pred"] != "und" and x["explained"] > 0 and x["explained"] >= least[x["lang_pred"]]}
    kept = {x["doc_id"] for x in P.language_id(spark, df, "").collect()}
    assert kept == want and {2001, 2003} & kept == set() and 2002 in kept


def test_share_explained_by_hand(spark):
    from stillwater.llm.language_id import EXPLAINED_BY, Judge, grams, train

    r = random.Random(3)
    make = lambda a, n: " ".join("".join(r.choice(a) for _ in range(r.randint(1, 5))) + r.choice(["", ",", "-a", "!"]) for _ in range(n))
    df = spark.createDataFrame([(i, make("abcdef" if i % 2 else "efghij", 50), "x" if i % 2 else "y") for i in range(40)], "doc_id long, text string, lang string")
    model = train(df, "text", "lang", "doc_id", per_order=60)
    judge = Judge(model, limit=400, explains=True)
    for text in [make("abcdefghij", n) for n in (1, 3, 40, 300, 300, 300)] + ["123", "жда abc"]:
        lang, _, share = judge.judge(text)
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        found = [model.index[EXPLAINED_BY].get(g, 0) for w in words for g in grams(w, EXPLAINED_BY)]
        assert share == (sum(model.usual[i][model.langs.index(lang)] for i in found) / len(found) if found else 0.0)


def test_workers_let_go_of_what_other_kinds_of_tasks_kept(spark):
    """A worker that has packed doesn't hold the tokenizer through the stages that follow, nor a model through the packing."""
    import os

    import pyarrow as pa
    from stillwater.llm.common import alone, map_arrow, per_worker

    df = spark.range(0, 400, numPartitions=16)
    out = "pid long, kinds string"

    def kept(n):
        from stillwater.llm import common

        return pa.RecordBatch.from_arrays([pa.array([os.getpid()] * n), pa.array([",".join(sorted(common._MADE))] * n)], ["pid", "kinds"])

    def keeps(kind):
        def make():
            per_worker(kind, "x", lambda source: [source])
            return lambda b: kept(b.num_rows)

        return {tuple(r) for r in map_arrow(df, make, out).collect()}

    def keeps_nothing(batches):
        for b in batches:
            yield kept(b.num_rows)

    one = keeps("one")
    assert {kinds for _, kinds in one} == {"one"}
    two = keeps("two")
    assert {kinds for _, kinds in two} == {"two"}
    assert {x for x, _ in one} & {x for x, _ in two}  # the same workers
    assert {r[1] for r in df.mapInArrow(alone(keeps_nothing), out).collect()} == {""}
    keeps("one")
    assert {r[1] for r in map_arrow(df, lambda: lambda b: kept(b.num_rows), out).collect()} == {""}


def test_the_driver_broadcasts_bounded_tables(spark, monkeypatch):
    """More rows than fit beside each other on a small driver are not broadcast: identifiers go as bits, edges and labels meet in a shuffle."""
    from stillwater.llm.common import only
    from stillwater.llm.components import smallest_reachable

    sent, mark = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append((df.count(), df.toArrow().nbytes)) or mark(df))
    n = 120_000
    docs = spark.range(0, 3 * n).select(F.when(F.col("id") > 0, F.col("id") - 1).alias("doc_id"), F.col("id").cast("string").alias("_bits"))
    ids = spark.range(0, n).select(F.when(F.col("id") > 0, F.col("id") * 2).alias("wanted"))
    got = only(docs, "doc_id", ids)
    assert got.columns == docs.columns
    found = got.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").count()
    assert found == n and n <= got.count() < n + 0.2 * 2 * n
    edges = spark.range(0, n).filter("id % 2 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = smallest_reachable(spark.range(0, n).select(F.col("id").alias("v"), F.col("id").alias("label")), edges)
    assert labels.filter(F.col("label") != F.col("v") - F.col("v") % 2).isEmpty() and labels.count() == n
    assert sent and all(rows <= 50_000 and size < 2**23 + 1000 for rows, size in sent), sent


def test_near_dedup_by_bits_and_shuffles(spark, monkeypatch):
    """With nothing small enough to be broadcast, and a filter of so few bits that most rows pass, groups are the same."""
    from stillwater.llm import common, components
    from stillwater.llm.near_dedup import near_dedup

    r = random.Random(12)
    base = [[f"w{r.randrange(5000)}" for _ in range(60)] for _ in range(40)]
    rows = [(None if i == 7 else i, " ".join(w if i % 3 else [*w[:59], f"x{i}"])) for i, w in enumerate(base * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(near_dedup(df).collect(), key=str)
    monkeypatch.setattr(common, "SMALL_ROWS", -1)
    monkeypatch.setattr(components, "SMALL_ROWS", -1)
    for words in (1, 1 << 20):
        monkeypatch.setattr(common, "FILTER_WORDS", words)
        assert sorted(near_dedup(df).collect(), key=str) == want
    assert len({x["component_id"] for x in want}) < len(want)


def test_median_explained_is_that_of_all_training_rows(spark, monkeypatch):
    """The model may be fitted on drawn rows; the least share that a language asks for comes from every labelled row outside the held-out fold."""
    from stillwater.llm import language_id as L

    r = random.Random(5)
    make = lambda a, n: "".join(r.choice(a) for _ in range(n))
    letters = "".join(map(chr, range(0x4E00, 0x9000)))
    # texts with ever more words of letters that hardly another text has, so that the shares differ from row to row
    text = lambda a, n: " ".join([make(a, 4) for _ in range(40)] + [make(letters, 3) for _ in range(n)])
    rows = [(i, text("abcd", i % 37), "x") for i in range(301)] + [(1000 + i, text("efgh", i % 37), "y") for i in range(240)] + [(2000 + i, text("abcd", 3 * i), None) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = df.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    monkeypatch.setattr(L, "drawn", lambda *a, all_drawn=L.drawn: all_drawn(*a[:4], 40))
    model = L.train(learn, "text", "lang", "doc_id")
    judge = L.Judge(model, explains=True)
    shares = {x: sorted(share for t, lang in learn.select("text", "lang").collect() if lang == x for guess, _, share in [judge.judge(t)] if guess == x and share > 0) for x in model.langs}
    least = [shares[x][(len(shares[x]) - 1) // 2] / 2 for x in model.langs]
    assert all(len(v) > 100 and v[0] < v[-1] for v in shares.values())
    assert L.least_explained(learn, model, "text", "lang", "doc_id") == least
    verdicts = {i: judge.judge(t) for i, t, _ in rows}
    kept = {x["doc_id"] for x in P.language_id(spark, df, "").collect()}
    assert 0 < len(kept) < len(rows)
    assert kept == {i for i, (lang, _, share) in verdicts.items() if lang != "und" and 0 < share >= dict(zip(model.langs, least))[lang]}
