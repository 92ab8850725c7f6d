import math
import sqlite3

import pytest

from pyspark.sql import functions as F

from letterloom.functions import text as T
from letterloom.functions import values as V
from letterloom.operators import ingest, lexical, vectors


def one(spark, column, **values):
    df = spark.range(1)
    for name, v in values.items():
        df = df.withColumn(name, F.lit(v))
    return df.select(column).first()[0]


def test_text(spark):
    assert one(spark, T.match_expression(F.lit("Board meeting, totals? a"))) == "board AND meeting AND totals"
    assert one(spark, T.html_to_text(F.lit("<p>a</p><br>b&amp;c<script>x</script>"))) == "a b&c"
    assert one(spark, T.normal_header(F.lit(" Net  revenue: "))) == "Net revenue"
    paragraphs = "\n\n".join(("a" * 500, "b" * 400, "c" * 100))
    assert [len(c) for c in one(spark, T.chunks(F.lit(paragraphs)))] == [500, 502]
    assert one(spark, T.chunks(F.lit(None).cast("string"))) == []
    assert [len(c) for c in one(spark, T.chunks(F.lit("x" * 2000)))] == [2000]


def test_values(spark):
    for cell, want in (("1.234", 1.234), ("1,234", 1234.0), ("1,23", 1.23), ("1.234,56", 1234.56), ("€ 5", 5.0), ("12%", None), ("1234,56", None), ("nan", None)):
        assert one(spark, V.cell_number(F.lit(cell))) == want
    day = F.lit("2024-03-02").cast("date")
    assert abs(one(spark, V.time_boost(day, F.lit("2024-01-01").cast("date"), F.lit("2024-02-01").cast("date"), 1.0)) - 2.71828**-0.5) < 1e-9
    assert [one(spark, V.needs_ocr(F.lit(n), F.lit(p))) for n, p in ((500, 5), (700, 5), (200, 0))] == [True, False, True]


def test_bm25_equals_fts5(spark):
    texts = ["the pump report is late", "pump pump report", "a report", "no such thing here", "pump report and one more report"]
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize=\"unicode61 remove_diacritics 2 tokenchars '._-@'\")")
    c.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts)))
    want = dict(c.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH 'pump AND report'"))
    df = spark.createDataFrame(list(enumerate(texts)) + [], "id long, t string")
    got = {r["id"]: r["score"] for r in lexical.search(df, "id", ["t"], ["pump", "report"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert lexical.search(df, "id", ["t"], []).count() == 0


def test_every_question_is_asked(spark):
    from letterloom.operators import fusion

    df = spark.createDataFrame([(1, "pump report pump"), (2, "pump report of the valve"), (3, "the report"), (4, None), (5, "pump " * 9 + "report")], "id long, t string")
    asked = {7: ["pump", "report"], 8: ["report"], 9: ["report", "nowhere"]}
    questions = spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    got = sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in lexical.search_each(df, "id", ["t"], questions).collect())
    want = sorted((k, r["id"], round(r["score"], 9)) for k, q in asked.items() for r in lexical.search(df, "id", ["t"], q).collect())
    assert got == want and len(got) == 7
    a = spark.createDataFrame([(7, 1, 1), (8, 1, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(7, 2, 1), (8, 1, 1)], "query_id long, id long, rank int")
    fused = {(r["query_id"], r["id"]): r["score"] for r in fusion.fuse(a, b, ["query_id", "id"]).collect()}
    assert fused == {(7, 1): 1 / 61, (7, 2): 1 / 61, (8, 1): 1 / 62 + 1 / 61}


def _asked_at_random(spark, n=60):
    import random

    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 14))) for _ in range(n)] + ["", None, "a b c d e f g h i j", "a b c d e f g h i j"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    asked = {100 + i: sorted({r.choice("abcdefghij") for _ in range(r.randint(1, 9))}) for i in range(40)} | {200 + i: list("abcdefghij")[: i + 1] for i in range(10)} | {300: ["a", "nowhere"], 301: [], 302: ["b", "a"]}
    return docs, asked, spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")


def test_questions_go_to_the_documents(spark, capsys):
    docs, asked, questions = _asked_at_random(spark)
    found = lexical.search_each(docs, "id", ["t"], questions, block_bytes=600)
    rows = docs.select("id", T.terms(F.col("t")).alias("ts")).collect()
    n, avgdl = len(rows), sum(len(r["ts"]) for r in rows) / len(rows)
    df = {t: sum(t in r["ts"] for r in rows) for t in "abcdefghij"}
    idf = {t: max(math.log((n - x + 0.5) / (x + 0.5)), 0) or 1e-6 for t, x in df.items()}
    want = {(q, r["id"]): -sum(idf[t] * r["ts"].count(t) * 2.2 / (r["ts"].count(t) + 1.2 * (0.25 + 0.75 * len(r["ts"]) / avgdl)) for t in terms) for q, terms in asked.items() for r in rows if terms and set(terms) <= set(r["ts"])}
    got = {(r["query_id"], r["id"]): r["score"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)
    found.explain()
    plan = capsys.readouterr().out  # no candidate pair is joined or shuffled
    assert "Join" not in plan and "Exchange" not in plan and plan.count("MapInArrow") > 1
    assert lexical.search_each(docs.limit(0), "id", ["t"], questions).count() == lexical.search_each(docs, "id", ["t"], questions.limit(0)).count() == 0


def test_union_of_the_best_of_two_tables(spark):
    docs, asked, questions = _asked_at_random(spark)

    def union(k):
        of = lambda name, shift: lexical.search_each(docs.withColumn("id", F.col("id") + shift), "id", ["t"], questions, k).withColumn("source", F.lit(name))
        return sorted(map(tuple, lexical.top_each(of("document", 0).unionByName(of("chunk", 1000)), ["score", F.desc("source"), "id"], 3).select("query_id", "source", "id", "rank").collect()))

    assert union(3) == union(None) and len({r[0] for r in union(3)}) > 30


def test_a_task_keeps_the_best_of_each_question(spark):
    docs, asked, questions = _asked_at_random(spark)
    kept = lexical.search_each(docs.coalesce(1), "id", ["t"], questions, 2)
    best = sorted(map(tuple, lexical.top_each(lexical.search_each(docs, "id", ["t"], questions), ["score", "id"], 2).select("query_id", "id", "score").collect()))
    assert sorted(map(tuple, kept.select("query_id", "id", "score").collect())) == best
    same = spark.createDataFrame([(i, "a b") for i in (5, 3, 9, 1)], "id long, t string").coalesce(1)
    assert [r["id"] for r in lexical.search_each(same, "id", ["t"], questions.where("query_id = 302"), 2).orderBy("id").collect()] == [1, 3]  # ties by key


def test_snippets_of_the_pairs_found(spark):
    docs, asked, questions = _asked_at_random(spark)
    found = lexical.search_each(docs, "id", ["t"], questions, snippet=4)
    told = found.join(docs, "id").join(questions, "query_id").select("snippet", T.snippet(F.col("t"), F.col("terms"), 4).alias("want")).collect()
    assert len(told) > 50 and all(r["snippet"] == r["want"] for r in told)


def test_fused_ranks_of_every_question(spark):
    from letterloom.operators import fusion

    docs, asked, questions = _asked_at_random(spark)
    near = spark.createDataFrame([(q, i, r) for q in asked for r, i in enumerate((q % 7, 20, 40), 1)], "query_id long, id long, rank int")

    def fused(k):
        words = lexical.top_each(lexical.search_each(docs.repartition(3), "id", ["t"], questions, k), ["score", "id"], 5)
        return sorted(map(tuple, fusion.fuse(words, near, ["query_id", "id"]).fillna(0).select("query_id", "id", "lexical_rank", "vector_rank").collect()))

    assert fused(5) == fused(None) and {q for q, *_ in fused(5)} == set(asked)


def test_terms_are_read_from_whole_buffers(spark):
    texts = ["Ab.c d-e ÀÉx ﬁ straße", "ΌΔΟΣ ΣΑΣ x", "İstanbul I i", None, "", "!? \n", "日本 語 한글 \U0001d54f\U0001f600 ½ x́", "a\x00b ﻿c"] + ["word%d über" % i for i in range(50)]
    docs = spark.createDataFrame([(i, t, t and t[::-1]) for i, t in enumerate(texts)], "id long, t string, u string")
    docs = docs.unionByName(docs.limit(1).selectExpr("99L AS id", "cast(unhex('61FF62C3') AS string) AS t", "'ok' AS u"))
    table, letters = lexical._folds(spark)
    want = {r["id"]: r["ts"] for r in docs.select("id", F.concat(T.terms(F.col("t")), T.terms(F.col("u"))).alias("ts")).collect()}
    batch, got = lexical._readable(docs, "id", ["t", "u"], letters).toArrow().combine_chunks().to_batches()[0], {}
    assert 3 <= len(batch) - batch.column("ts").null_count < 10  # the rest is not cut by Spark
    for size in (1, 100, 4_000_000):
        for keys, lengths, flat in lexical._read(batch, "id", table, size):
            for k, n, end in zip(keys.to_pylist(), lengths, lengths.cumsum(), strict=True):
                got[k] = flat.slice(end - n, n).to_pylist()
        assert got == want
    points = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    wrong = points.where(~F.col("c").isin(*letters)).select("id", T.terms(F.col("c")).alias("ts")).toArrow()
    assert [r["id"] for r in wrong.to_pylist() if (r["ts"] or [""])[0] != (chr(table[r["id"]]) if table[r["id"]] else "")] == []


def test_nearest_and_hash(spark):
    rows = [(i, [float(i), 0.0]) for i in range(20)]
    v = spark.createDataFrame(rows, "vec_id long, v array<float>")
    q = v.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "v AS q")
    got = [(r["query_id"], r["vec_id"]) for r in vectors.nearest(q, v, 3, block=1).orderBy("query_id", "rank").collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (10, 10), (10, 9), (10, 11)]
    vec = one(spark, vectors.hash_embedding(F.lit("abc"), 8))
    assert abs(sum(x * x for x in vec) - 1) < 1e-9


def test_ingest_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, None, 1), (4, "b", 1)], "id long, k string, at int")
    first = ingest.insert_or_ignore(df, df.limit(0), "k", ["at", "id"])
    assert sorted(r["id"] for r in first.collect()) == [2, 4]
    assert ingest.insert_or_ignore(df, first, "k", ["at", "id"]).count() == 0


def test_snippet_addresses_hypotheses(spark):
    assert one(spark, T.snippet(F.lit("a b c d the pump is here and more words follow it"), ["pump"], 4)) == "…d the [pump] is…"
    assert one(spark, T.snippet(F.lit("no match"), ["pump"])) == "no match"
    assert one(spark, T.addresses(F.lit('Ann <a@x.example>, "b" <b@x.example>'))) == ["a@x.example", "b@x.example"]
    assert one(spark, T.addresses(F.lit(None).cast("string"))) == []
    got = one(spark, T.hypotheses(F.lit('x {"temporal_hypotheses":[{"from_date":"2024-01-01T00","to":"2024-02-01"},{"from":"2024-01-01"}]} y')))
    assert [tuple(h) for h in got] == [("2024-01-01", "2024-02-01", 1.0)]


def test_sinks(spark, tmp_path):
    from letterloom.sources import sinks

    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    sinks.write_csv(df, str(tmp_path / "c"), one_file=True)
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 2
    assert sorted(r["json"] for r in sinks.json_lines(df).collect()) == ['{"n":1,"t":"a"}', '{"n":2}']
    seen, observation = sinks.counted(df)
    seen.collect()
    assert observation.get["rows"] == 2


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "bm25_topk", "chunk_paragraphs", "year_metric_totals"])
def test_same_for_any_partitioning(spark, data, name):
    from letterloom.plans import catalogue

    got = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(repr, catalogue.QUERIES[name](spark, data).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]
