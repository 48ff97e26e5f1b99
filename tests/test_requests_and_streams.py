"""Edge cases of requests, file readers, and streams against batches."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from riskloom.functions import dates, scalars
from riskloom.operators.features import event_vectors
from riskloom.plans import scoring
from riskloom.sources import json_array, lenient, requests
from riskloom.streaming import connections
from riskloom.streaming import scoring_stream as stream

SF = "/root/testdata/sf0.001"
GOOD = {
    "transaction": {"amount": 500.0, "installments": 6, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 250.0, "tx_count_24h": 5, "known_merchants": ["M1", "M2"]},
    "merchant": {"id": "M1", "mcc": "5411", "avg_amount": 60.0},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23},
    "last_transaction": {"timestamp": "2026-03-11T14:45:53Z", "km_from_current": 13.7},
}
WANT = [500, 5000, 2000, 7826, 3333, 1667, 137, 292, 2500, 0, 10000, 0, 1500, 60]


def changed(**path):
    out = json.loads(json.dumps(GOOD))
    for k, v in path.items():
        a, b = k.split("__")
        out[a][b] = v
    return json.dumps(out)


def vector(spark, body):
    rows = spark.createDataFrame([(1, body)], "id long, body string")
    r = scoring.request_vectors(rows, "id").first()
    return None if r["malformed"] else list(r["q"])


def test_worked_example(spark):
    assert vector(spark, json.dumps(GOOD)) == WANT


@pytest.mark.parametrize(
    ("body", "at", "value"),
    [
        (json.dumps(GOOD | {"last_transaction": None}), 5, -10000),
        (json.dumps({k: v for k, v in GOOD.items() if k != "last_transaction"}), 6, -10000),
        (changed(customer__known_merchants=[f"X{i}" for i in range(16)] + ["M1"]), 11, 10000),
        (changed(customer__known_merchants=[f"X{i}" for i in range(15)] + ["M1"]), 11, 0),
        (changed(customer__avg_amount=0), 2, 10000),
        (changed(last_transaction__timestamp="2026-03-12T00:00:00Z"), 5, 0),
        (changed(merchant__mcc="123"), 12, 5000),
        (changed(transaction__requested_at="2026-03-11T18:45:53+03:00"), 3, 7826),
        (json.dumps(GOOD | {"more": {"a": [1, {"b": None}]}}), 0, 500),
        (json.dumps(GOOD).replace('"amount": 500.0', '"amount": 1.0, "amount": 500.0'), 0, 500),
        (json.dumps(GOOD) + " trailing", 0, 500),
        (json.dumps({"transaction": GOOD["transaction"]}), 11, 10000),
    ],
)
def test_accepted_requests(spark, body, at, value):
    assert vector(spark, body)[at] == value


@pytest.mark.parametrize("body", [None, "", "[]", '{"transaction":', changed(transaction__installments=2.5), changed(transaction__amount=None), changed(terminal__is_online=1), changed(transaction__requested_at="2026-03-11"), changed(last_transaction__timestamp="x")])
def test_malformed_requests_are_approved(spark, body):
    assert vector(spark, body) is None
    members = event_vectors(spark.read.parquet(f"{SF}/events.parquet"))
    r = scoring.score_requests(spark.createDataFrame([(1, body)], "id long, body string"), "id", members).first()
    assert (r["n"], r["approved"], r["fraud_score"], r["response"]) == (0, True, 0.0, '{"approved":true,"fraud_score":0.0}')


def test_http_framing(spark):
    head = "POST /fraud-score HTTP/1.1\r\nContent-Length: 4\r\n\r\n"
    cases = {"GET / H": "incomplete", "GET /ready HTTP/1.1\r\n\r\n": "ready", "POST /fraud-score HTTP/1.1\r\n\r\nab": "bad", head + "abc": "incomplete", head + "é12rest": "score", "DELETE /x HTTP/1.1\r\n\r\n": "other"}
    found = {r["value"]: (r["route"], r["body"]) for r in requests.read_http(spark.createDataFrame([(k,) for k in cases], "value string")).collect()}
    assert {k: v[0] for k, v in found.items()} == cases and found[head + "é12rest"][1] == "é12"


def test_vector_files(spark, tmp_path):
    rows = [{"vector": [0.5] * 14, "label": "fraud", "x": 1}, {"vector": [1.0, 2.0], "label": "legit"}, {"vector": [1.0]}, {"label": "fraud"}, {"vector": [3.0] * 20, "label": "odd"}]
    (tmp_path / "v.json").write_text(json.dumps(rows))
    found = requests.read_vectors(spark, f"file://{tmp_path}/v.json").collect()
    assert [(len(r["vector"]), r["vector"][2], r["is_fraud"]) for r in found] == [(14, 0.5, 1), (14, 0.0, 0), (14, 3.0, 0)]
    (tmp_path / "bad.json").write_text('[{"vector": [1.0], "label": "fraud"}, {"vector": ["x"], "label": "fraud"}]')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        requests.read_vectors(spark, f"file://{tmp_path}/bad.json").collect()
    (tmp_path / "e.json").write_text(json.dumps({"entries": [{"request": GOOD, "expected_approved": True, "expected_fraud_score": 0.2}]}))
    e = requests.read_entries(spark, f"file://{tmp_path}/e.json").first()
    assert e["expected_approved"] and e["request"]["merchant"]["id"] == "M1"


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(scalars.round_half_away(F.lit(x))) for x in (0.5, 1.5, -0.5, -1.5, 0.49999997, -2.4)] == [1, 2, -1, -2, 0, -2]
    assert [one(scalars.quantize_one(F.lit(x))) for x in (2.0, -7.0, 0.00005, 0.12345)] == [10000, -10000, 1, 1235]
    assert one(dates.day_of_week(dates.parse_ts(F.lit("2026-03-11T18:45:53Z")))) == 2
    assert one(dates.epoch_seconds(dates.parse_ts(F.lit("1969-12-31T23:59:59")))) == -1
    assert one(dates.parse_ts(F.lit("2026-03-11T18:45"))) is None and one(dates.parse_ts(F.lit("2026-13-11T18:45:00Z"))) is None
    assert one(scalars.bitset_popcount(F.array(F.lit(-1).cast("long"), F.lit(5).cast("long")))) == 66
    wide = F.array_repeat(F.lit(3), 200)
    assert one(scalars.l2(wide, F.array_repeat(F.lit(1), 200), 200)) == 800


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    stream.run_once(stream.window_counts(stream.event_stream(spark, SF)), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    found = spark.read.parquet(f"file://{tmp_path}/out")
    batch = stream.window_counts(spark.read.parquet(f"{SF}/events.parquet"))
    last = batch.agg(F.max("day")).first()[0]
    closed = batch.where(F.col("day") < last)  # the day that the watermark has not passed is still open
    assert found.exceptAll(batch).count() == 0 and closed.exceptAll(found).count() == 0


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    bodies = [(i, changed(transaction__amount=10.0 * i) if i % 5 else "{") for i in range(40)]
    rows = spark.createDataFrame(bodies, "event_id long, body string").repartition(4)
    rows.write.parquet(f"file://{tmp_path}/in")
    members = event_vectors(spark.read.parquet(f"{SF}/events.parquet")).cache()
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
    stream.score_stream(source, members, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    found = spark.read.parquet(f"file://{tmp_path}/out").drop("batch")
    want = scoring.score_requests(rows, "event_id", members)
    assert found.count() == 40 and found.select(want.columns).exceptAll(want).count() == 0


def test_a_user_away_for_a_week_keeps_the_last_event(spark, tmp_path):
    from riskloom.operators.features import user_history
    from riskloom.streaming.user_state import user_state

    day, start = 86400, 1_700_000_000
    secs = {1: [0, 10, day, 8 * day, 8 * day + 5], 2: [5, 3 * day, 3 * day, 20 * day], 3: [4 * day], None: [day]}
    rows = [(i, u, t) for i, (u, t) in enumerate((u, t) for u, each in secs.items() for t in each)]
    base = spark.createDataFrame([(i, u, i % 7, start + t) for i, u, t in rows], "event_id long, user_id long, k int, sec long")
    base = base.withColumns({"ts": F.timestamp_seconds("sec").cast("timestamp_ntz"), "cents": F.lit(100).cast("long")})
    found = stream.run_in_steps(stream.in_time_steps(base, 5, False), user_state, f"file://{tmp_path}")
    columns = ["event_id", "user_id", "tx_count_24h", "last_sec", "last_k"]
    found, want = found.select(columns), user_history(base).select(columns)
    assert found.count() == want.count() and found.exceptAll(want).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_requests_come_whole_out_of_any_chunks(spark, tmp_path, size):
    score = b"POST /fraud-score HTTP/1.1\r\ncontent-length: 3\r\n\r\n{1}"
    flows = {1: score + b"GET /ready HTTP/1.1\r\n\r\n" + score, 2: score + b"POST /fraud-score HTTP/1.1\r\n\r\n" + score, 3: b"GET / HTTP/1.1\r\n\r\n" + score[:-1], 4: b""}
    want = {1: ["score", "ready", "score"], 2: ["score", "bad"], 3: ["other"]}
    chunks = [(c, k, data[at : at + size]) for c, data in flows.items() for k, at in enumerate(range(0, len(data), size))]
    rows = spark.createDataFrame(chunks, "conn int, seq long, chunk binary")
    late = [rows.where("seq % 3 = 1"), rows.where("seq % 3 = 2"), rows.where("seq % 3 = 0")]
    found = stream.run_in_steps(late, connections.reassembled, f"file://{tmp_path}").orderBy("conn", "turn").collect()
    assert {c: [r["route"] for r in found if r["conn"] == c] for c in want} == want and len(found) == 6
    assert {r["body"] for r in found} == {"{1}", None} and [r["turn"] for r in found] == [0, 1, 2, 0, 1, 0]


def test_streams_of_nothing(spark, tmp_path):
    none = spark.read.parquet(f"{SF}/events.parquet").limit(0)
    assert stream.run_in_steps(stream.in_time_steps(none), stream.window_counts, f"file://{tmp_path}").count() == 0


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (json.dumps(GOOD), True),
        (json.dumps(GOOD).replace(",", " "), True),
        (json.dumps(GOOD).replace(",", " , "), True),
        (json.dumps(GOOD | {"x": {"y": ["]", {"z": 1}]}, "w": "a } b", "v": -1.5e3}) + "rest", True),
        (json.dumps(dict(reversed(GOOD.items()))), True),
        ("[1]", False),
        (None, False),
        ("", False),
        (json.dumps(GOOD)[:-1], False),
        (json.dumps(GOOD).replace("500.0", "null"), False),
        (json.dumps(GOOD).replace('"installments": 6', '"installments": 6.5'), False),
        (json.dumps(GOOD).replace("false", "0"), False),
    ],
)
def test_lenient_requests(spark, body, want):
    rows = spark.createDataFrame([(1, body)], "id long, body string")
    r = lenient.parse_lenient(rows).first()
    assert r["malformed"] != want
    if want:
        flat = requests.flatten_payload(lenient.parse_lenient(rows)).first()
        assert (flat["amount"], flat["installments"], flat["is_known"], flat["km_from_home"]) == (500.0, 6, True, pytest.approx(29.23))


def test_lenient_numbers_and_members():
    read = lambda x: lenient.read_request(b'{"transaction":{"amount":' + x + b"}}")
    assert read(b"-1.25")["transaction"]["amount"] == -1.25 and read(b"1.5e2")["transaction"]["amount"] == 150.0 and read(b".5")["transaction"]["amount"] == 0.5
    assert read(b"x") is None and read(b"1e") is None and read(b"true") is None
    twice = b'{"merchant":{"id":"a" "mcc":"1"} "merchant":{"id":"b"} "last_transaction":null}'
    assert lenient.read_request(twice) == {"merchant": {"id": "b", "mcc": "1"}, "last_transaction": None}
    assert lenient.read_request(b'{"customer":{"known_merchants":["A" "B", "C"]}}')["customer"]["known_merchants"] == ["A", "B", "C"]
    assert lenient.read_request(b'{"transaction":{"installments":4294967297}}')["transaction"]["installments"] == 1


@pytest.mark.parametrize("split", ["64", "300", "1m"])
def test_json_arrays_are_read_by_byte_ranges(spark, tmp_path, split):
    odd = ['a } b', 'q " { [', "back\\slash", "", "line\nbreak", "é}]"]
    rows = [{"vec": [i, -1.5], "name": odd[i % 6], "in": {"deep": [{"x": i}]} if i % 4 == 0 else None} for i in range(60)]
    (tmp_path / "a.json").write_text(" [ " + ",\n".join(json.dumps(r, ensure_ascii=i % 2 == 0) for i, r in enumerate(rows)) + " ] \n")
    (tmp_path / "e.json").write_text(json.dumps({"about": {"n": [1]}, "entries": rows, "tail": "}"}))
    with gzip.open(tmp_path / "z.json.gz", "wt") as f:
        json.dump(rows, f)
    want = sorted(json.dumps(r, sort_keys=True) for r in rows)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for name, level in (("a.json", 1), ("e.json", 2), ("z.json.gz", 1)):
            found = json_array.array_elements(spark, f"file://{tmp_path}/{name}", level)
            assert sorted(json.dumps(json.loads(r["text"]), sort_keys=True) for r in found.collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_bad_number_fails_an_array(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"vector": [1.0], "label": "fraud"}, {"vector": ["x"], "label": "fraud"}]')
    (tmp_path / "none.json").write_text(" [ ] ")
    assert json_array.read_json_array(spark, f"file://{tmp_path}/none.json", requests.VECTORS).count() == 0
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        json_array.read_json_array(spark, f"file://{tmp_path}/bad.json", requests.VECTORS).collect()


def test_state_of_a_user_is_touched_once_a_batch():
    from types import SimpleNamespace

    import pandas as pd

    from riskloom.streaming.user_state import DAY, KEPT, UserPast

    calls, held = [], [None]
    value = SimpleNamespace(get=lambda: calls.append("get") or held[0], update=lambda x: calls.append("update") or held.__setitem__(0, x))
    handle = SimpleNamespace(getValueState=lambda *_: value, registerTimer=calls.append)
    user = UserPast()
    user.init(handle)
    rows = pd.DataFrame({"event_id": range(100), "us": [i * 10**6 for i in range(100)], "sec": range(100), "k": 1})
    none = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    assert list(user.handleInputRows((7,), iter([rows]), none))[0]["tx_count_24h"].tolist() == list(range(100))
    assert calls == ["get", "update", (99 + KEPT) * 1000]
    late = rows.head(1).assign(event_id=200, sec=DAY + 50, us=(DAY + 50) * 10**6)
    out = list(user.handleInputRows((7,), iter([late]), none))[0]
    assert out["tx_count_24h"].tolist() == [50] and out["last_sec"].tolist() == [99]
    user.handleExpiredTimer((7,), none, SimpleNamespace(getExpiryTimeInMs=lambda: (99 + KEPT) * 1000))
    assert held[0][4] == [DAY + 50] and held[0][2] == DAY + 50


def test_stream_scores_by_pages_that_are_made_once(spark, tmp_path, monkeypatch):
    """A stream reads the members once, whatever its batches, and gets the votes that all pairs give."""
    from riskloom.operators import blocks, knn
    from riskloom.plans.scoring import request_vectors

    made, to_pages = [], blocks.to_pages
    monkeypatch.setattr(blocks, "to_pages", lambda layout: made.append(1) or to_pages(layout))
    rows = spark.createDataFrame([(i, changed(transaction__amount=7.0 * i)) for i in range(30)], "event_id long, body string").repartition(3)
    rows.write.parquet(f"file://{tmp_path}/in")
    members = event_vectors(spark.read.parquet(f"{SF}/events.parquet")).cache()
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    stream.score_stream(source, members, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    found = {r["query_id"]: r["n"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    asked = request_vectors(rows, "event_id").select("vec_id", "q")
    assert len(made) == 1 and found == {r["query_id"]: r["n"] for r in knn.vote(knn.knn_exact(asked, members), asked).collect()}
