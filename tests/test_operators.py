"""Exact values and edge cases of the other operators."""

import http.server
import json
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sablefin import cli
from sablefin.errors import CancelledError, ConfigError, DimensionError, ModelError, PatternError, RateLimitError, ScorerError, StoreError, ValidationError
from sablefin.functions.patterns import TEXT_RULES
from sablefin.operators import estimate, features, graph, leases, runs, sampling, score, tokenise
from sablefin.plans.api import Sablefin
from sablefin.plans.control import ProfileCache, RunControl
from sablefin.sources import tables
from sablefin.streaming import detection as streaming


def test_similarities(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(graph.cosine(F.col("a"), F.col("b"))).collect()] == [0, 1, 0, 0, 0]
    sets = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in sets.select(graph.jaccard(F.col("a"), F.col("b"))).collect()] == [0.333333, 1, 0]


def test_pagerank_of_a_hub(spark):
    nodes = spark.range(6)
    edges = spark.createDataFrame([(0, i, 1.0) for i in range(1, 6)], "src long, dst long, weight double")
    ranks = {r.id: r.rank for r in graph.pagerank(nodes, graph.undirected_links(edges)).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) == 0 and len({round(ranks[i], 9) for i in range(1, 6)}) == 1
    lonely = {r.id: r.rank for r in graph.pagerank(nodes, graph.undirected_links(edges.where("false"))).collect()}
    assert all(abs(x - 1 / 6) < 1e-9 for x in lonely.values())
    weighted = spark.createDataFrame([(0, 1, 9.0), (0, 2, 1.0)], "src long, dst long, weight double")
    ranks = {r.id: r.rank for r in graph.pagerank(spark.range(3), graph.weighted_links(weighted)).collect()}
    assert ranks[1] > ranks[2] > ranks[0]


def test_nearest(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = graph.nearest(df, df.where("vec_id = 1"), k=3).orderBy("place").collect()
    assert [(r.id, round(r.distance, 6)) for r in found] == [(1, 0), (2, 1), (3, 1)]
    assert graph.nearest(df.limit(0), df, k=3).count() == 0 and graph.nearest(df, df.limit(0), k=3).count() == 0
    with pytest.raises(Exception, match="length"):
        graph.nearest(df, spark.createDataFrame([(9, [1.0])], "vec_id long, embedding array<float>")).collect()


def test_features_by_hand(spark):
    df = spark.createDataFrame([("c", "ab1 "), ("c", "aé!"), ("e", "")], "column_name string, value string")
    ratios = {r.column_name: r for r in features.class_ratios(df).collect()}
    assert (ratios["c"].digits, ratios["c"].letters, ratios["c"].blanks, ratios["c"].special) == (0.142857, 0.571429, 0.142857, 0.142857)
    assert ratios["e"].letters == 0
    assert {r.column_name: r.mean_length for r in features.length_stats(df).collect()} == {"c": 4.0, "e": 0.0}
    assert spark.range(1).select(features.char_ngrams(F.lit("abcd"), 3), features.char_ngrams(F.lit("ab"), 3)).first()[:] == (["abc", "bcd"], [])
    vector = features.feature_vectors(df.where("column_name = 'c'")).first().features
    assert len(vector) == 376 and abs(sum(vector[-64:]) - 1) < 1e-5


def test_classification(spark):
    values = {"n": ["1", "-2.5", "1e3", ".5", "inf"], "t": ["a long piece of prose here"] * 3, "u": ["x", "y"], "m": ["1", "2", "x"], "blank": [" 1", "1f"]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "column_name string, value string")
    assert {r.column_name: r.column_type for r in features.classify(df).collect()} == {"n": "Numeric", "t": "TextLong", "u": "Unknown", "m": "Unknown", "blank": "Unknown"}
    with pytest.raises(KeyError):
        features.require_columns(df, ["nope"])


def test_latest_rows(spark):
    rows = [(1, 1, 0, "a"), (1, 2, 0, "b"), (1, 2, 1, None), (2, 1, 0, "c")]
    df = spark.createDataFrame(rows, "k long, at long, tie long, v string")
    assert {(r.k, r.v) for r in runs.latest(df, ["k"], "at", ["tie"]).collect()} == {(1, None), (2, "c")}


def test_workers(spark):
    columns = spark.createDataFrame([(i, f"c{i}") for i in range(10)], "position long, column_name string")
    dealt = runs.assign(columns, 3)
    assert [r.worker for r in dealt.orderBy("position").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    moved = {r.position: r.worker for r in runs.redistribute(dealt, 1).collect()}
    assert moved == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 2, 7: 2, 8: 2, 9: 2}
    assert runs.assign(columns.limit(0), 3).count() == 0


def test_plateau(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([0.2, 0.96, 0.96, 0.97, 0.97])], "batch long, confidence double")
    found = sampling.with_stop(df, window=3).orderBy("batch").collect()
    assert [r.should_stop for r in found] == [False, False, False, True, True]


def test_adaptive_sampling_stops_early_on_dense_data(spark):
    customers = spark.range(1, 20_001).toDF("c_custkey")
    dense = tables.contacts(customers)
    history = sampling.adaptive(dense, "id", ["email", "ssn", "phone"], sampling.SamplingConfig(least=500, threshold=0.6)).orderBy("batch").collect()
    assert history[-1].should_stop and history[-1].rows_processed < 10_000
    sparse = dense.select("id", F.lit("nothing").alias("email"))
    history = sampling.adaptive(sparse, "id", ["email"], sampling.SamplingConfig(least=2000, most=20_000)).orderBy("batch").collect()
    assert not history[-1].should_stop and history[-1].rows_processed == 20_000
    assert sampling.adaptive(dense.limit(0), "id", ["email"]).count() == 0


def test_stream_stops(spark, tmp_path):
    contacts = tables.contacts(spark.range(1, 201).toDF("c_custkey"))
    contacts.repartition(20, "id").write.parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema(contacts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    stopped = streaming.detect_stream(stream(), ["email", "ssn", "phone"], window=3, threshold=0.5).collect()
    assert any(r.should_stop for r in stopped) and max(r.rows_processed for r in stopped) < 200
    limited = streaming.detect_stream(stream(), ["email"], max_rows=25).collect()
    assert 25 <= max(r.rows_processed for r in limited) < 200


def test_event_time_windows(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "view", 1.0), ("2024-01-01 00:20:00", "view", 2.0), ("2024-01-01 03:00:00", "view", 4.0)], "t string, event_type string, value double")
    events.select(F.to_timestamp("t").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    query = streaming.clicks_by_window(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.n, r.total) for r in spark.table("windows").collect()) == [(1, 4.0), (2, 3.0)]


def test_scorer_hook(spark):
    df = spark.createDataFrame([(i, f"text {i} a{i}@b.com") for i in range(25)], "id long, text string").repartition(2)
    found = Sablefin(spark).score(df, "text", lambda texts: [float("@" in t) for t in texts], batch=10)
    assert found.count() == 25 and {r.score for r in found.collect()} == {0.0}
    with pytest.raises(Exception, match="scores for"):
        score.with_scorer(df, "text", lambda texts: [1.0]).collect()


def test_fields_of_prompts(spark):
    prompt = "Field: a\nText: great\nField: b\nnothing\nField: c\nText: bad: text\n tickets: x 12"
    df = spark.createDataFrame([(prompt,), ("",), (None,)], "p string")
    found = [[tuple(x) for x in r[0]] if r[0] is not None else None for r in df.select(score.extract_fields(F.col("p"))).collect()]
    assert found[:2] == [[("a", "great"), ("c", "bad: text")], []]
    assert [r[0] for r in df.select(score.number_after(F.col("p"), "tickets")).collect()] == [12, None, None]


def test_cache_survivors(spark):
    rows = [("a", 100, 5), ("b", 90, 5), ("c", 80, 5), ("a", 10, 5), ("old", 1, 1)]
    df = spark.createDataFrame(rows, "k string, at long, size int").withColumn("at", F.timestamp_seconds("at"))
    now = F.timestamp_seconds(F.lit(100))
    left = lambda n, b: [r.k for r in tokenise.survivors(df, "k", "at", F.col("size"), now, n, b, 50).orderBy("running_bytes").collect()]
    assert left(9, 99) == ["a", "b", "c"] and left(2, 99) == ["a", "b"] and left(9, 9) == ["a"]


def test_custom_patterns(spark):
    library = Sablefin(spark)
    with pytest.raises(PatternError):
        library.add_pattern("X", "(")
    library.add_pattern("CUSTOM_1", r"\bK-\d+\b")
    df = spark.createDataFrame([(1, "K-12 K-13")], "id long, text string")
    assert {r.pattern_type: r.matches for r in library.detect(df, "id").collect()} == {"CUSTOM_1": 2}
    done, tokens = library.obfuscate(df, "id", "text")
    assert library.restore(done, "id", "text", tokens).first().text == "K-12 K-13"


def test_command_line(spark, tmp_path):
    path = str(tmp_path / "people.csv")
    with open(path, "w") as out:
        out.write("id,name,review_notes\n1,Ann,great a@b.com and c@d.org\n2,Bob,bad 123-45-6789\n3,Cy,\n")
    rules = str(tmp_path / "rules.json")
    assert {r.pattern_type for r in cli.run(spark, ["detect", path, "--patterns", rules]).collect()} >= {"EMAIL", "SSN"}
    hidden = cli.run(spark, ["obfuscate", path, "--columns", "review_notes", "--patterns", rules, "--output", str(tmp_path / "out"), "--format", "csv"])
    assert "great [EMAIL-1] and [EMAIL-2]" in [r.review_notes for r in hidden.collect()] or "great [EMAIL-0] and [EMAIL-1]" in [r.review_notes for r in hidden.collect()]
    assert cli.run(spark, ["analyze", path]).count() == 3
    assert cli.run(spark, ["analyze", path, "--dry-run", "--columns", "name,review_notes"]).first().estimated_time_seconds == 0
    assert cli.run(spark, ["profile", path]).first().name == "review_notes"
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_command_line_hides_all_columns_and_restores_them(spark, tmp_path):
    path, kept, out = (str(tmp_path / x) for x in ("people.csv", "dictionary", "hidden"))
    with open(path, "w") as lines:
        lines.write("id,mail,notes\n1,a@b.com,123-45-6789 of a@b.com\n2,c@d.org,\n")
    hidden = cli.run(spark, ["obfuscate", path, "--dictionary", kept, "--output", out, "--format", "csv"]).orderBy("id").collect()
    assert not any("@" in str(r) or "6789" in str(r) for r in hidden)
    named = cli.run(spark, ["obfuscate", path, "--columns", "mail,notes"]).orderBy("id").collect()
    assert [(r.mail, r.notes) for r in named] == [(r.mail, r.notes) for r in hidden]
    back = cli.run(spark, ["restore", out, "--dictionary", kept, "--columns", "mail,notes"]).orderBy("id").collect()
    assert [(r.mail, r.notes) for r in back] == [("a@b.com", "123-45-6789 of a@b.com"), ("c@d.org", None)]
    with pytest.raises(ConfigError):
        cli.run(spark, ["restore", out])


def test_outside_scorer_sees_no_number(spark):
    long = "word " * 30_000 + "123-45-6789"
    df = spark.createDataFrame([(1, long), (1, long), (None, "123-45-6789"), (2, None)], "id long, text string")
    found = Sablefin(spark).score(df, "text", lambda texts: [float("6789" in (t or "")) for t in texts]).collect()
    assert sorted((str(r.id), r.text or "", r.score) for r in found) == sorted((str(k), t or "", 0.0) for k, t in [(1, long), (1, long), (None, "123-45-6789"), (2, None)])


#: A value of every kind of the library, as a text may hold it.
PRIVATE = {
    "EMAIL": "a.person@example.org",
    "SSN": "123-45-6789",
    "PHONE": "555-123-4567",
    "CREDIT_CARD": "4111111111111111",
    "IP_ADDRESS": "10.21.32.43",
    "DATE_OF_BIRTH": "1990-12-31",
    "MRN": "MRN: 7654321",
    "DRIVERS_LICENSE": "D1234567",
    "BANK_ACCOUNT": "12345678901",
    "PASSPORT": "passport: X98765Z",
}


def test_outside_scorer_sees_no_kind_of_the_library(spark):
    library = Sablefin(spark)
    assert set(PRIVATE) == set(library.library)
    library.add_pattern("BADGE", "badge-[a-z]+")
    values = [*PRIVATE.values(), "badge-secret"]
    texts = [f"x {v} y" for v in values] + [" ".join(values), "plain \ue000 text", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def scorer(seen):
        return [-1.0 if t is None else float(sum(v in t for v in values)) + 100 * t.count("[") for t in seen]

    found = {r.id: r.score for r in library.score(df, "text", scorer).collect()}
    shown = {i: s % 100 for i, s in found.items() if s >= 0}
    assert not any(shown.values()), shown
    assert all(found[i] >= 100 for i in range(len(values))) and found[len(values)] >= 100 * len(values)
    assert found[len(values) + 1] == 0


def test_second_obfuscate_keeps_the_first_restorable(spark, tmp_path):
    kept, out = str(tmp_path / "kept"), [str(tmp_path / n) for n in ("one", "two")]
    files = [str(tmp_path / f"{n}.csv") for n in ("one", "two")]
    rows = ["id,mail\n1,a@b.com\n2,c@d.org\n", "id,mail\n1,e@f.net\n2,a@b.com\n3,[EMAIL-0]\n"]
    for path, text in zip(files, rows):
        with open(path, "w") as lines:
            lines.write(text)
    for path, target in zip(files, out):
        cli.run(spark, ["obfuscate", path, "--dictionary", kept, "--output", target, "--format", "csv"])
    tokens = spark.read.parquet(kept).collect()
    assert len({r.token for r in tokens}) == len({r.original for r in tokens}) == len(tokens) == 4
    back = [[r.mail for r in cli.run(spark, ["restore", x, "--dictionary", kept, "--columns", "mail"]).orderBy("id").collect()] for x in out]
    assert back == [["a@b.com", "c@d.org"], ["e@f.net", "a@b.com", "[EMAIL-0]"]]


def test_retries_and_waits(spark, monkeypatch):
    waited, calls = [], []
    monkeypatch.setattr(score.time, "sleep", waited.append)

    def scorer(texts):
        calls.append(texts)
        if len(calls) == 1:
            raise RateLimitError(retry_after=7.0)
        if len(calls) == 2:
            raise ScorerError("busy")
        return [1.0] * len(texts)

    assert score._scored(scorer, ["a"], 3, 0.5) == [1.0] and waited == [7.0, 1.0]
    with pytest.raises(ModelError):
        score._scored(lambda texts: [], ["a"], 3, 0.5)  # not worth another try
    calls.clear()
    with pytest.raises(RateLimitError):
        score._scored(scorer, ["a"], 0, 0.5)


def test_endpoint(spark):
    seen = []

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["texts"]
            seen.append(self.headers.get("Authorization"))
            if texts == ["slow down"]:
                self.send_response(429)
                self.send_header("Retry-After", "3")
                self.end_headers()
                return
            self.send_response(200 if texts != ["bad"] else 500)
            self.end_headers()
            self.wfile.write(json.dumps({"scores": [len(t) for t in texts]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        scorer = score.EndpointScorer(f"http://127.0.0.1:{server.server_port}", "key", 5.0)
        assert scorer(["a", "bcd"]) == [1, 3] and seen == ["Bearer key"]
        with pytest.raises(RateLimitError) as limit:
            scorer(["slow down"])
        assert limit.value.retry_after == 3.0
        with pytest.raises(ScorerError):
            scorer(["bad"])
    finally:
        server.shutdown()


def test_prompt_parsers(spark):
    df = spark.createDataFrame([('{"a": "x", "b": 1}',), ("no json",), (None,)], "p string")
    found = [[tuple(x) for x in r[0]] for r in df.select(score.json_fields(F.col("p"), ["b", "a", "c"])).collect()]
    assert found == [[("b", "1"), ("a", "x")], [], []]
    prompt = "CUST-000001 support_tickets: 3 payment_delays 2\nCUST-000002 nothing\nCUST-12"
    df = spark.createDataFrame([(prompt,), ("none",)], "p string")
    found = [[tuple(x) for x in r[0]] for r in df.select(score.customer_records(F.col("p"))).collect()]
    assert found == [[("CUST-000001", 3, 2), ("CUST-000002", 0, 0)], []]


def test_customer_ids_of_more_than_six_digits_stay_whole(spark):
    prompt = "CUST-999999 support_tickets: 3\nCUST-1000000 payment_delays = 2.\nCUST-12345"
    df = spark.createDataFrame([(prompt,)], "p string")
    found = [tuple(x) for x in df.select(score.customer_records(F.col("p"))).first()[0]]
    assert found == [("CUST-999999", 3, 0), ("CUST-1000000", 0, 2)]


def test_nearest_in_blocks_equals_a_plain_search(spark, monkeypatch):
    rng = np.random.RandomState(3)
    points = rng.randint(0, 4, (400, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(1000, None)], "vec_id long, embedding array<double>").repartition(5)
    plain = {(q, n + 1, i) for q in range(0, 400, 7) for n, i in enumerate(np.lexsort((np.arange(400), ((points - points[q]) ** 2).sum(axis=1)))[:6])}
    for most, chunk in ((100_000, 1024), (10, 3)):
        monkeypatch.setattr(graph, "MAX_QUERIES", most)
        monkeypatch.setattr(graph, "QUERY_CHUNK", chunk)
        assert {(r.query_id, r.place, r.id) for r in graph.nearest(df, df.where("vec_id % 7 = 0 AND vec_id < 400"), k=6).collect()} == plain
    few = graph.nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), k=6).collect()
    assert len(few) == 3


def test_nearest_passes_over_null_ids(spark):
    df = spark.createDataFrame([(1, [0.0]), (None, [0.0]), (2, [1.0]), (3, None)], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.id) for r in graph.nearest(df, df, k=1).orderBy("query_id").collect()] == [(1, 1), (2, 2)]


def test_ranks_against_a_matrix(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id long")
    edges = [(i, (i * i + 1) % 12, 1.0 + i % 3) for i in range(11)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    for links, weighted in ((graph.undirected_links, False), (graph.weighted_links, True)):
        share = np.zeros((12, 12))
        for a, b, w in edges:
            share[b, a] += w if weighted else 1
            if not weighted:
                share[a, b] += 1
        share /= np.maximum(share.sum(axis=0), 1e-300)
        rank = np.full(12, 1 / 12)
        for _ in range(10):
            rank = 0.15 / 12 + 0.85 * share @ rank
        found = graph.pagerank(nodes, links(df), most=10, tolerance=0.0).orderBy("id").collect()
        assert np.abs(np.array([r["rank"] for r in found]) - rank / rank.sum()).max() < 1e-12


def test_dispatch_keeps_every_request(spark):
    requests = spark.createDataFrame([(10, 2, "a"), (10, 2, "a"), (None, 2, "a"), (10, 2, None)], "rows long, columns long, chain_type string")
    samples = spark.createDataFrame([("a", 100, 2, 1000)], "chain_type string, rows long, columns long, elapsed_ms long")
    history = spark.createDataFrame([("a", 10, 2, 7)], "chain_type string, row_count long, column_count long, actual_seconds long")
    found = estimate.dispatch(requests, samples, history).collect()
    assert sorted((str(r.rows), str(r.chain_type), r.method) for r in found) == [("10", "None", "default"), ("10", "a", "historical"), ("10", "a", "historical"), ("None", "a", "default")]


def test_too_many_nodes(spark, monkeypatch):
    """Beyond the bound nodes are not all compared: equal vectors count as one, and a threshold that all pairs meet is refused."""
    monkeypatch.setattr(graph, "MAX_NODES", 2)
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(4)], "id long, embedding array<double>")
    with pytest.raises(ValidationError):
        graph.similarity_graph(df, threshold=0.0)
    with pytest.raises(ValidationError):
        graph.pairs(df)
    assert [(r.src, r.dst) for r in graph.similarity_graph(df, threshold=0.5).collect()] == [(0, 1)]


def test_database_read_by_parts(spark):
    url = "jdbc:derby:memory:sablefin;create=true"
    rows = spark.createDataFrame([(i, f"name {i}") for i in range(100)], "id int, name string")
    rows.write.format("jdbc").options(url=url, dbtable="people").save()
    whole = tables.jdbc(spark, url, 'SELECT "id", "name" FROM people WHERE "id" < 90')
    parts = tables.jdbc(spark, url, 'SELECT "id", "name" FROM people WHERE "id" < 90', column="id", lower=10, upper=80, partitions=4)
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) and whole.count() == 90
    with pytest.raises(ConfigError):
        tables.jdbc(spark, url, "SELECT 1", column="ID")


def test_runs_in_the_background(spark):
    control = RunControl(spark)
    done = control.start(lambda: spark.range(10).count())
    assert control.result(done, 60) == 10 and control.status(done) == "completed" and not control.cancel(done)
    failed = control.start(lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        control.result(failed, 60)
    assert control.status(failed) == "failed"
    slow = control.start(lambda: spark.range(0, 10**13, 1, 4).selectExpr("count_if(id % 7 = 3)").collect())
    time.sleep(1.5)
    assert control.status(slow) == "running" and control.cancel(slow) and control.status(slow) == "cancelled"
    with pytest.raises(CancelledError):
        control.result(slow, 60)
    with pytest.raises(StoreError):
        control.status("none")


def test_profiles_are_kept_for_a_while(spark):
    now, made = [0.0], []
    cache = ProfileCache(10, lambda: now[0])
    make = lambda: made.append(1) or spark.range(3)
    assert len(cache.get("a", make)) == 3 and len(cache.get("a", make)) == 3 and len(made) == 1
    now[0] = 10.0
    cache.get("a", make)
    cache.invalidate("a")
    cache.get("a", make)
    assert len(made) == 3 and (cache.hits, cache.misses) == (1, 3)


def test_cache_entries(spark):
    entries = spark.createDataFrame([("a/1",), ("a/2",), ("b",)], "cache_key string")
    assert [r[0] for r in runs.invalidated(entries, "a/").collect()] == ["b"] and runs.invalidated(entries).count() == 0


def test_calls_in_flight_keep_one_quota(spark):
    """Twelve partitions with up to five calls each: never more calls in any stretch than the quota, several at once, rows in
    their places."""
    begun, running, most = [], [0], [0]
    guard = threading.Lock()

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            with guard:
                begun.append(time.monotonic())
                running[0] += 1
                most[0] = max(most[0], running[0])
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["texts"]
            time.sleep(0.15 + 0.1 * (len(texts[0]) % 3))
            with guard:
                running[0] -= 1
            self.send_response(500 if "x12" in texts and len(begun) < 30 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"scores": [float(t[1:]) for t in texts]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = spark.range(0, 96, 1, 12).select("id", F.concat(F.lit("x"), F.col("id").cast("string")).alias("text"))
        scorer = score.EndpointScorer(f"http://127.0.0.1:{server.server_port}")
        rows = score.with_scorer(df, "text", scorer, batch=2, retries=40, wait=0.0, in_flight=5, per_second_in_all=25.0).collect()
    finally:
        server.shutdown()
    assert [(r.id, r.score) for r in rows] == [(i, float(i)) for i in range(96)]
    assert len(begun) >= 48 and most[0] > 2
    begun.sort()
    # The i-th call comes i / 25 s behind the first one or later; that may itself have been held up on a busy machine.
    assert all(t - begun[0] >= i / 25 - 1 for i, t in enumerate(begun))


def test_lease_without_a_driver(spark):
    lease = leases.Lease(spark, 1.0)
    lease._place = ("127.0.0.1", 1)
    with pytest.raises(ScorerError):
        lease.take()


def test_pairs_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(features, "PAIR_BYTES", 7)
    texts = ["abcabcabcabcabca", "", None, "x", "\u00e4\U0001f600\u00e4bc", "seven77", "eight888"]
    df = spark.createDataFrame([("c", t) for t in texts], "column_name string, value string").coalesce(1)
    wanted = {}
    for t in texts:
        for a, b in zip(t or "", [*(t or "")[1:], None]):
            wanted[a, b] = wanted.get((a, b), 0) + 1
    assert {(chr(r.a), r.b if r.b is None else chr(r.b)): r.n for r in features.pair_counts(df).collect()} == wanted


def test_ngrams_of_repeated_and_null_keys(spark):
    rows = [(1, "a b a b"), (2, "c d"), (2, "c d e"), (3, "one"), (4, None), (None, "x y"), (None, "y z")]
    found = features.ngram_kinds(spark.createDataFrame(rows, "k long, t string"), "k", "t", 2)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 3, 2, "a b"), (2, 3, 2, "c d"), (None, 2, 2, "x y")], key=str)


def test_all_matches_of_a_text_are_those_of_its_words(spark):
    texts = ["mail a@b.com, (c@d.org) a@b.com\nx@y.z e.f@g-h.net;123-45-6789 1123-45-6789 123-45-6789\t999-99-9999", "@ - a@ b.com", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for _, regex in TEXT_RULES:
        plan = df.select(tokenise._matches(F.col("t"), regex, None).alias("words"), F.array_distinct(F.regexp_extract_all("t", F.lit(regex), F.lit(0))).alias("whole"))
        assert all(list(dict.fromkeys(r.words or [])) == (r.whole or []) for r in plan.collect())
        assert "split" in plan._jdf.queryExecution().optimizedPlan().toString()
