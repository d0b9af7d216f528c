"""Operators on small fixtures: awkward values, published results, invariants."""

import math
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import codebook, labels, text
from corpusloom.operators import agreement, annotate, corpus, estimate, graph, learn, lexicon, report, sampling
from corpusloom.sources import readers, writers
from corpusloom.streaming.incremental import resume


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("a &amp;lt; b", "a < b"),
        ("x ```code\nmore``` y", "x y"),
        ("> quoted\nkept words", "kept words"),
        ("see [the docs](http://a.b/c) now", "see the docs now"),
        ("go http://x.y/z there", "go there"),
        ("ask /u/some_one in r/place", "ask in"),
        ("your/their **bold**", "you bold"),
        ("# Header\ntext", "Header text"),
        ("a  b", "a b"),
        ("    indented code\nafter", "after"),
        (None, None),
    ],
)
def test_normalise(spark, raw, clean):
    assert one(spark, raw, text.normalise) == clean


def test_read_label(spark):
    levels = codebook.LEVELS["stance"]
    for raw, want in [("1", "trust"), ("2.", "distrust"), ("TRUST", "trust"), ("dis", "distrust"), (" non evaluative ", "non_evaluative"), ("9", None), ("junk", None), ("", None), (None, None), ("a", "ambivalent")]:
        assert one(spark, raw, lambda c: labels.read_label(c, levels)) == want, raw
    for raw, want in [("x", True), ("Yes", True), ("0", False), (None, False)]:
        assert one(spark, raw, labels.read_flag) is want


def test_funnel_of_comments(spark):
    rows = [
        ("a", "one two three four of the and it", "x", None, None, "2026-03-02 00:00:00"), ("b", "one two three", "x", None, None, "2026-03-02 00:00:00"), ("c", "[deleted]", "x", None, None, "2026-03-02 00:00:00"),
        ("d", "the the the the", "AutoModerator", None, None, "2026-03-02 00:00:00"), ("e", "the the the the", None, None, None, "2026-03-02 00:00:00"), ("f", "the the the the", "X-ModTeam", None, None, "2026-03-02 00:00:00"),
        ("g", "the the the the", "x", True, None, "2026-03-02 00:00:00"), ("h", "the the the the", "x", None, "moderator", "2026-03-02 00:00:00"), ("i", "the the the the", "x", None, None, "2026-09-01 00:00:00"), ("j", None, "x", None, None, "2026-03-02 00:00:00"),
    ]
    df = spark.createDataFrame(rows, "id string, body string, author string, stickied boolean, distinguished string, ts string").withColumn("created_ts", F.to_timestamp("ts"))
    df, steps = corpus.comment_steps(df, "2026-03-01", "2026-09-01")
    assert [r.n for r in corpus.funnel(df, steps).orderBy("step_no").collect()] == [10, 9, 7, 5, 4, 2, 1, 1]
    assert [r.id for r in corpus.passing(df, steps).collect()] == ["a"]


def test_reply_depth(spark):
    rows = [("a", "t3_x"), ("b", "t1_a"), ("c", "t1_b"), ("d", "t1_gone"), ("e", "t1_f"), ("f", "t1_e"), ("g", None), ("h", "t1"), *((f"n{i}", f"t1_n{i - 1}" if i else "t3_y") for i in range(40))]
    got = {r.id: r.depth for r in corpus.reply_depth(spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    assert [got[k] for k in "abcdefgh"] == [0, 1, 2, None, None, None, None, None]
    assert all(got[f"n{i}"] == i for i in range(40))


def test_krippendorff_kappa_and_empty(spark):
    pairs = [("a", "a")] * 45 + [("b", "b")] * 35 + [("a", "b")] * 12 + [("b", "a")] * 8
    df = spark.createDataFrame(pairs, "truth string, pred string")
    r = agreement.krippendorff(agreement.long_pairs(df, {"v": ("truth", "pred")})).first()
    p = (110 / 200) ** 2 + (90 / 200) ** 2
    assert math.isclose(r.alpha, 1 - 0.2 / ((1 - p) * 200 / 199), rel_tol=1e-9)
    k = agreement.cohen_kappa(agreement.confusion(df, []), []).first()
    pe = (57 * 53 + 43 * 47) / 10_000
    assert math.isclose(k.kappa, (0.8 - pe) / (1 - pe), rel_tol=1e-9)
    assert agreement.krippendorff(agreement.long_pairs(df.where("false"), {"v": ("truth", "pred")})).count() == 0


def test_chi_square_and_bh(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 5)], "a string, b string, n long")
    r = estimate.chi_square(cells, "a", "b").first()
    want = 65 * (10 * 5 - 20 * 30) ** 2 / (30 * 35 * 40 * 25)
    assert math.isclose(r.chi2, want, rel_tol=1e-9) and r.df == 1
    assert math.isclose(estimate.chi_square_p(3.841458820694124, 1), 0.05, rel_tol=1e-6)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.5)], "t string, p double")
    assert [round(x.p_adj, 4) for x in estimate.bh_adjust(p, "p", "t").orderBy("p").collect()] == [0.04, 0.04, 0.04, 0.5]


def test_entities_and_edges(spark):
    for raw, want in [("gpt-4", "ChatGPT"), ("4o", "ChatGPT"), ("Open AI", "OpenAI"), ("bosses and CEOs", "Bosses and Ceos"), ("AI.", "AI (general)"), ("", "")]:
        assert one(spark, raw, graph.canonical_entity) == want
    t = spark.createDataFrame([("gpt-4", "model", "threatens", "jobs", "harm", "distrusting"), ("4o", "model", "threatens", "jobs", "harm", "trusting"), ("x", "actor", "r", "x", "actor", "neutral"), ("", "actor", "r", "y", "actor", "neutral")], "subject string, subject_type string, relation string, object string, object_type string, valence string")
    e = graph.edges(graph.clean_triples(t)).collect()
    assert len(e) == 1 and e[0].weight == 2 and e[0].sign == 0


def test_graph_measures(spark):
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "subject string, object string")
    assert {r.node: r.betweenness for r in graph.betweenness(path).collect()} == {"a": 0, "b": 2, "c": 2, "d": 0}
    two = spark.createDataFrame([(a, b, 1) for g in ("abcd", "efgh") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "e", 1)], "a string, b string, weight long")
    part = {r.node: r.community for r in graph.communities(two).collect()}
    assert len(set(part.values())) == 2 and part["a"] == part["d"] != part["e"] == part["h"]
    assert graph.modularity(two, graph.communities(two)).first().modularity > 0.4
    assert len({r.community for r in graph.label_propagation(two, 4).collect()}) <= 8


def test_sampling_invariants(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 15, "s").otherwise("l").alias("stratum"), F.lit("g").alias("g"))
    design = sampling.allocate(df.groupBy("stratum", "g").agg(F.count(F.lit(1)).alias("pop_n")), "g", 200, {"g": 1.0})
    got = {r.stratum: r.alloc_n for r in design.collect()}
    assert got["s"] == 15
    n = {r.stratum: r["count"] for r in sampling.systematic(df, design.drop("g"), "stratum", "id").groupBy("stratum").count().collect()}
    assert n == got
    off = sampling.systematic(df, design.drop("g"), "stratum", "id", offset=sampling.random_offset("x", "stratum"))
    assert abs(off.count() - sum(got.values())) <= 2
    ranks = sampling.ranked(df.repartition(5), "stratum", "id").collect()
    assert all(r.rank__ == (r.id + 1 if r.id < 15 else r.id - 14) for r in ranks) and len(ranks) == 1000
    nulls = spark.createDataFrame([(None, 2), (None, 1), ("a", 1)], "g string, v long")
    assert {(r.g, r.v): r.rank__ for r in sampling.ranked(nulls, "g", "v").collect()} == {(None, 1): 1, (None, 2): 2, ("a", 1): 1}
    assert sampling.ranked(nulls.where("false"), "g", "v").count() == 0


def test_bootstrap_and_tails(spark):
    e = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("e"), (F.col("id") % 2).alias("s"))
    draws = estimate.bootstrap(e, "e", "id", 400, 200).agg(F.avg("correction").alias("m"), F.stddev("correction").alias("s")).first()
    assert abs(draws.m - 2.99) < 0.05 and abs(draws.s - 2 / 20) < 0.02
    assert estimate.bootstrap(e, "e", "id", 400, 50, stratum="s").count() == 50
    for z in (0.0, 0.5, 1.96, 2.8, 2.9, 4.0, 8.0, 12.0, -12.0, 30.0):
        assert math.isclose(one(spark, str(z), lambda c: estimate.normal_tail(c.cast("double"))), math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-10)
    assert one(spark, None, lambda c: estimate.normal_tail(c.cast("double"))) is None


def test_annotation(spark):
    b = spark.createDataFrame([("k1", ["1", "2", "3"], ["a b", "c", "d e f"]), ("k2", [], [])], "cache_key string, ids array<string>, texts array<string>")
    done = annotate.annotate(b, annotate.keyword_annotator, ceiling=30)
    assert [annotate.next_pause(*x) for x in ((0.0, False), (0.0, True), (100.0, True), (150.0, True), (12.0, False), (100.0, False))] == [0.0, 12 * 1.6, 160.0, 180.0, 12.0, 90.0]
    assert {r.cache_key: len(r.results) for r in done.collect()} == {"k1": 3, "k2": 0}
    cache = spark.createDataFrame([("k", ["1", "2"], [("9", "x"), ("2", "y")])], "cache_key string, ids array<string>, results array<struct<id:string,s:string>>")
    assert [r.id for r in annotate.repair_ids(cache).orderBy("position").collect()] == ["1", "2"]
    assert [(r.cache_key, r.purge) for r in annotate.purge_plan(done).orderBy("cache_key").collect()] == [("k1", False), ("k2", False)] and annotate.purge_short(done).count() == 2
    rules = annotate.label_rules({"relevance": F.lit("not_relevant"), "stance": F.lit("trust")}, {})
    assert spark.range(1).select(annotate.first_fault(rules).alias("r")).first().r == "stance without relevance"


def test_class_tfidf_counts_once(spark):
    """Whatever the counts are made of is worked out once, not once for each total."""
    seen = spark.sparkContext.accumulator(0)

    def watched(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "venue string, term string, n long").mapInPandas(watched, "venue string, term string, n long")
    got = {(r.venue, r.term): r.score for r in lexicon.class_tfidf(rows, "venue", 5).collect()}
    assert seen.value == 3
    assert got == pytest.approx({("a", "x"): math.log(2) / 3, ("a", "y"): 2 / 3 * math.log(3), ("b", "x"): math.log(2)})


def test_annotator_holds_one_batch_of_texts(spark):
    """However many batches come in one Arrow batch, the texts of one of them alone are Python objects."""

    def ask(ids, texts, ceiling):
        return [{"id": ids[0], "blocks": sys.getallocatedblocks()}]

    def least(rows):
        texts = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat_ws(" ", F.lit("text"), "id", i))
        b = spark.range(0, rows, 1, 1).select(F.col("id").cast("string").alias("cache_key"), F.array(F.col("id").cast("string")).alias("ids"), texts.alias("texts"))
        return annotate.annotate(b, ask).select(F.explode("results").alias("r")).agg(F.min(F.get_json_object("r", "$.blocks").cast("long"))).first()[0]

    least(10)
    assert least(8000) - least(10) < 100_000  # of 320,000 texts


def test_annotators(spark, tmp_path):
    import http.server
    import json
    import sys
    import threading

    script = tmp_path / "a.py"
    script.write_text("import json, sys\nasked = json.load(sys.stdin)\nprint('Sure:', json.dumps({'results': [{'id': i['id'], 'stance': 'trust'} for i in asked['items']]}))\n")
    assert annotate.command_annotator([sys.executable, str(script)])(["1", "2"], ["a", "b"], 9) == [{"id": "1", "stance": "trust"}, {"id": "2", "stance": "trust"}]
    with pytest.raises(OSError):
        annotate.command_annotator([sys.executable, "-c", "raise SystemExit(1)"])(["1"], ["a"], 9)
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((asked["response_format"]["type"], asked["max_tokens"]))
            ids = [i["id"] for i in json.loads(asked["messages"][1]["content"])]
            answer = json.dumps({"choices": [{"message": {"content": "```json\n" + json.dumps({"results": [{"id": i, "stance": "trust" if i == "1" else "odd"} for i in ids]}) + "\n```"}}]}).encode()
            self.send_response(200), self.end_headers(), self.wfile.write(answer)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = annotate.endpoint_annotator(f"http://127.0.0.1:{server.server_port}/v1", "m", "k", "label these", {"type": "object"})
    assert [r["id"] for r in ask(["1", "2"], ["a", "b"], 50)] == ["1", "2"]
    b = spark.createDataFrame([("k1", ["1", "2"], ["a", "b"])], "cache_key string, ids array<string>, texts array<string>")
    kept = annotate.annotate(b, ask, ceiling=50, fields={"stance": ["trust", "distrust"]}).first().results
    server.shutdown()
    assert [json.loads(r)["id"] for r in kept] == ["1"] and seen == [("json_schema", 50)] * 2 + [("json_schema", 100), ("json_schema", 200)]
    with pytest.raises(ValueError):
        annotate.results_in("no answer")


def test_lexicon(spark):
    assert one(spark, "Jobs and job-hunting; jobless", lambda c: lexicon.dictionary_hits(c, ["job*", "made up"])) == 3
    got = spark.createDataFrame([("not good but bad",)], "v string").select(text.tokens(F.col("v")).alias("t"))
    x = lexicon.net_tone(F.col("t"), ["good"], ["bad"])
    assert got.select(x["pos"].alias("p"), x["neg"].alias("n"), x["label"].alias("l")).first()[:] == (0, 2, "distrust")
    want = {"running": "run", "glass": "glass", "relational": "relat", "hopping": "hop", "ponies": "poni", "agreed": "agre", "generalizations": "gener", "oscillators": "oscil", "controlling": "control", "happy": "happi", "sky": "sky", "adoption": "adopt", "feed": "feed", "filing": "file", "be": "be", "été": "été"}
    assert {w: lexicon.stem_english(w) for w in want} == want
    assert spark.createDataFrame([(["running", "glass"],), (None,)], "t array<string>").select(lexicon.stems(F.col("t")).alias("s")).collect()[0].s == ["run", "glass"]
    d = {"good": ["good", "very good"], "not_good": ["not good"], "any": ["job*"]}
    t = spark.createDataFrame([("not good very good good jobless",), ("",)], "v string").select(text.tokens(F.col("v")).alias("t"))
    assert [tuple(r.k) for r in t.select(lexicon.dictionary_counts(F.col("t"), d).alias("k")).collect()] == [(2, 1, 1), (0, 0, 0)]


def test_learned(spark):
    v = spark.createDataFrame([(i, [float(i % 2) + 0.01 * i, float(i % 3)], float(i % 2)) for i in range(80)], "id long, e array<double>, y double")
    m = learn.elastic_net(learn.features(v, "e", []), "y", penalties=(0.1, 0.01), k=3)
    scored = m.transform(learn.features(v, "e", []))
    assert scored.where("prediction = y").count() > 70
    assert learn.elastic_net(learn.features(v.where("y = 1"), "e", []), "y") is None
    assert learn.separated(v, "y", "y").count() == 2
    three = v.withColumn("y", (F.col("id") % 3).cast("double"))
    m = learn.elastic_net(learn.features(three, "e", []), "y", penalties=(0.01,), k=3)
    assert m.numClasses == 3 and m.transform(learn.features(three, "e", [])).where("prediction = y").count() > 70
    for method in ("kmeans", "bisecting"):
        assert learn.cluster(v, "e", 3, 2, method=method).select("cluster").distinct().count() <= 3
    with pytest.raises(ValueError):
        learn.cluster(v, "e", 3, 2, method="other")
    dfm = spark.createDataFrame([(i, t, 1) for i in range(40) for t in (("sun", "moon", "star") if i % 2 else ("fish", "crab", "eel"))], "id long, term string, n long")
    topics = learn.seeded_topics(dfm, "id", {"sky": ["sun"], "sea": ["fish"]}, residual=0, sweeps=4)
    assert sum(r.topic == ("sky" if r.id % 2 else "sea") for r in topics.collect()) >= 36
    assert {(r.topic, r.term) for r in learn.top_terms(dfm, topics, "id", 3).where("topic = 'sky'").collect()} == {("sky", t) for t in ("sun", "moon", "star")}
    hits = spark.createDataFrame([(2, 1), (0, 0), (1, 1)], "a int, b int")
    assert [r.t for r in hits.select(learn.seed_topic({"x": F.col("a"), "y": F.col("b")}).alias("t")).collect()] == ["x", None, "x"]


def test_mixed_logit_finds_its_effects(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(150):
        u = float(rng.normal(0, 1.0))
        for _ in range(20):
            x = float(rng.normal())
            rows.append((g, x, float(rng.random() < 1 / (1 + math.exp(-(-0.5 + 1.0 * x + u))))))
    got = {r.term: r for r in learn.mixed_logit(spark.createDataFrame(rows, "g long, x double, y double"), "y", ["x"], "g").collect()}
    assert abs(got["x"].estimate - 1.0) < 0.2 and abs(got["(intercept)"].estimate + 0.5) < 0.3 and 0.6 < got["(sd)"].estimate < 1.3 and got["x"].p < 1e-6


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "raw.json").write_text('{"id":"a","body":"x","created_utc":1772409600,"permalink":"/r/s/comments/1/some_thread/z","parent_id":"t3_1","extra":1}\n{broken\n')
    raw = readers.read_ndjson(spark, str(tmp_path / "raw.json"))
    got = readers.ingest_comments(raw).first()
    assert raw.count() == 1 and readers.count_malformed(spark, str(tmp_path / "raw.json")) == 1
    assert (got.thread_slug, got.ym, got.is_top_level) == ("some thread", "2026-03", True)
    sheet = spark.createDataFrame([("1", "a,b"), ("2", "")], "id string, note string")
    writers.write_sheet(sheet, str(tmp_path / "s.csv"))
    assert (tmp_path / "s.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    assert [r.note for r in readers.read_strings(spark, str(tmp_path / "s.csv"), ["id", "note"]).collect()] == ["a,b", ""]
    path = str(tmp_path / "t.parquet")
    writers.write_parquet(spark.range(5).toDF("id"), path)
    writers.update_in_place(spark, path, lambda d: d.where("id < 3"))
    assert spark.read.parquet(path).count() == 3
    assert readers.optional(spark, str(tmp_path / "none")) is None
    assert readers.first_existing(spark, [str(tmp_path / "none"), path]) == path
    writers.assert_writable(spark, path)
    (tmp_path / "keys.txt").write_text("# c\n\n k1 \nk2\n")
    assert [r.line for r in readers.read_lines(spark, str(tmp_path / "keys.txt")).collect()] == ["k1", "k2"]
    b = spark.createDataFrame([("k1",), ("k2",)], "cache_key string")
    store = str(tmp_path / "cache")
    resume(spark, b.limit(1), store, lambda d: d)
    assert resume(spark, b, store, lambda d: d).count() == 2


def test_more_sources_and_sinks(spark, tmp_path):
    import json

    table = spark.createDataFrame([(1, "a|b"), (2, None)], "id long, note string")
    writers.write_csv(table, str(tmp_path / "csv"))
    back = readers.read_csv(spark, str(tmp_path / "csv"))
    assert dict(back.dtypes)["id"] == "int" and back.count() == 2
    writers.write_json(table, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert "| 1 | a\\|b |" in writers.markdown(table.orderBy("id"))
    assert writers.render("<b>__CODER__</b>", coder="x") == "<b>x</b>"
    for i in range(3):
        writers.append_log(spark, str(tmp_path / "log"), step=i)
    assert sorted(r.step for r in spark.read.json(str(tmp_path / "log")).collect()) == [0, 1, 2]
    (tmp_path / "na.csv").write_text("id,note\n1,NA\n2,\n")
    assert readers.read_strings(spark, str(tmp_path / "na.csv"), ["id", "note"], nulls="NA").where("id = 1").first().note is None
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfid,note\n1,x\n")
    assert readers.read_csv(spark, str(tmp_path / "bom.csv")).columns == ["id", "note"]
    for k in "ab":
        (tmp_path / f"batch-{k}.json").write_text(json.dumps({"cache_key": k, "results": [{"id": "1"}, {"id": "2"}]}))
    (tmp_path / "batch-c.json").write_text("broken")
    assert readers.read_json_cache(spark, str(tmp_path / "batch-*.json"), "id string").count() == 4
    spark.createDataFrame([("k", ["1"], ['{"id": "1", "s": "x"}'])], "cache_key string, ids array<string>, results array<string>").write.parquet(str(tmp_path / "cache.parquet"))
    assert readers.read_cache(spark, str(tmp_path / "cache.parquet"), "id string, s string").first().results[0].s == "x"
    there = str(tmp_path / "cache.parquet")
    assert readers.preferred(spark, [there], lambda: 1, lambda: 2) == 1 and readers.preferred(spark, [there, there + "x"], lambda: 1, lambda: 2) == 2
    wide = spark.createDataFrame([(1, 0.5, 0.25, 0.125)], "id long, e0 double, e10 double, e2 double")
    assert readers.wide_vector(wide, "e").first().embedding == [0.5, 0.125, 0.25]
    for name in ("x", "y"):
        (tmp_path / f"raw-{name}.json").write_text('{"id":"%s","body":"b"}\n' % name)
    assert readers.read_ndjson(spark, str(tmp_path / "raw-*.json")).count() == 2
    assert corpus.with_default(table, "stickied", False, "boolean").first().stickied is False and corpus.with_default(table, "note", "z", "string") is table
    assert "a|b" in report.listing(table, "L1") and report.listing(table, "L1").startswith("== L1")
    assert report.throughput(table, 2, 7200)["rows"] == 2
    assert graph.title_case(F.lit("x")) is not None and one(spark, "google v. oracle vs meta v us", graph.title_case) == "Google v. Oracle vs Meta v Us"
