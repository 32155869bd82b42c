"""The store's log of commits, and its single-file JSON form."""

import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from labelspark.sources import commits as C
from labelspark.sources import store as S
from labelspark.sources.application_file import (
    parse_documents, read_application_file, unreadable_files, write_application_file,
)

ENTRY = '{"proof":"80","unknown":{"deep":[1,null]}}'


def entry(id_, bucket="under_review", status="Needs review"):
    return (id_, f"Brand {id_}", "Gin", status, ENTRY, bytearray(b"\x00png"), '{"results":[]}', bucket)


@pytest.fixture
def path(spark, tmp_path):
    S.append_entries(spark.createDataFrame([entry("L1"), entry("L2"), entry("L3")], S.STORE_SCHEMA), str(tmp_path))
    return str(tmp_path)


def decision(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, bucket string")


def buckets(spark, path, at=None):
    return {r.id: r.bucket for r in S.read_store(spark, path, at).collect()}


def test_interleaved_writers_keep_both_decisions(spark, path):
    """The second writer starts and ends between the first one's rows and its claim."""
    second = lambda: S.decide(decision(spark, ("L2", "rejected")), path)
    C.commit(S.log_rows(decision(spark, ("L1", "approved"))), path, "log", before_claim=second)
    assert buckets(spark, path) == {"L1": "approved", "L2": "rejected", "L3": "under_review"}
    assert [c[0] for c in C.commits(spark, path)] == [1, 2, 3]


def test_a_taken_number_is_tried_again(spark, path, monkeypatch):
    monkeypatch.setattr(C, "version", lambda spark, path: 0)  # a stale listing: number 1 is taken
    assert S.decide(decision(spark, ("L1", "approved")), path) == 2
    assert S.decide(decision(spark, ("L1", "rejected")), path) == 3
    assert buckets(spark, path)["L1"] == "rejected"


def test_many_writers_at_once(spark, path):
    def write(i):
        return S.decide(decision(spark, (f"W{i}", "approved"), ("L1", f"b{i}")), path)

    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(write, range(12)))
    assert sorted(numbers) == list(range(2, 14))
    state = buckets(spark, path)
    assert {f"W{i}" for i in range(12)} <= state.keys()
    assert state["L1"] == f"b{numbers.index(13)}"


def test_whole_rewrite_of_a_changed_store_conflicts(spark, path):
    at = C.version(spark, path)
    seen = S.read_store(spark, path, at)
    S.decide(decision(spark, ("L1", "approved")), path)
    with pytest.raises(C.CommitConflict):
        S.write_store(seen, path, read_at=at)
    assert buckets(spark, path)["L1"] == "approved"
    assert S.write_store(S.read_store(spark, path), path, read_at=2) == 3


def test_payload_stays_with_its_entry(spark, path):
    S.decide(decision(spark, ("L1", "approved"), ("new", "rejected")), path)
    rows = {r.id: r for r in S.read_store(spark, path).collect()}
    assert (rows["L1"].brand_name, rows["L1"].app_data, bytes(rows["L1"].image_bytes), rows["L1"].bucket) == (
        "Brand L1", ENTRY, b"\x00png", "approved")
    assert (rows["new"].brand_name, rows["new"].bucket) == (None, "rejected")
    S.decide(spark.createDataFrame([entry("L1", "rejected", "Critical issues")], S.STORE_SCHEMA), path)
    again = S.read_store(spark, path).where("id = 'L1'").first()
    assert (again.overall_status, again.bucket) == ("Critical issues", "rejected")


def test_snapshots_and_old_versions(spark, path):
    S.decide(decision(spark, ("L1", "approved")), path)
    first = {tuple(map(str, r)) for r in S.read_store(spark, path).collect()}
    # a decision falls between the state a snapshot is made of and its commit
    at = C.version(spark, path)
    state = S.read_store(spark, path, at)
    late = lambda: S.decide(decision(spark, ("L2", "rejected")), path)
    assert C.commit(S.log_rows(state), path, "snapshot", upto=at, before_claim=late) == 4
    S.decide(decision(spark, ("L3", "approved")), path)
    assert buckets(spark, path) == {"L1": "approved", "L2": "rejected", "L3": "approved"}
    assert {tuple(map(str, r)) for r in S.read_store(spark, path, 2).collect()} == first
    before = buckets(spark, path)
    S.compact(spark, path)
    assert buckets(spark, path) == before
    data = S.read_store(spark, path).inputFiles()
    assert len({f.rsplit("/", 2)[1] for f in data}) == 1


def test_order_within_a_commit_and_unfinished_commits(spark, path):
    events = spark.createDataFrame([("L1", "rejected", 5), ("L1", "approved", 9), ("L1", "under_review", 2)], "id string, bucket string, ts long")
    S.decide(events, path, order="ts")
    S.log_rows(decision(spark, ("L1", "lost"))).write.parquet(f"{path}/data-{'0' * 32}")  # its writer stopped here
    assert buckets(spark, path)["L1"] == "approved"
    assert S.read_store(spark, path + "/absent").count() == 0


def test_merged_equals_replaying_the_log(spark):
    rng = random.Random(1)
    rows, state = [], {}
    for number in range(1, 60):
        id_, whole = f"e{rng.randrange(8)}", rng.random() < 0.4
        payload = (f"b{number}", "c", "s", "{}", None, None) if whole else None
        bucket = rng.choice(S.BUCKETS + [None])
        rows.append((id_, payload, bucket, number // 3, number))
        old = state.get(id_, (None, None))
        state[id_] = (payload[0] if whole else old[0], bucket or old[1])
    log = spark.createDataFrame(rows, S._LOG_SCHEMA.replace("seq long", "number long, seq long")).repartition(5)
    assert {r.id: (r.brand_name, r.bucket) for r in S.merged(log).collect()} == state


REFERENCE = {
    "under_review": [{"id": "a", "brand_name": "Ö & Co", "class_type": "Gin", "overall_status": "Needs review", "image_bytes": "AHBuZw==",
                      "app_data": {"proof": "80", "new": {"x": [1, None]}}, "result": {"counts": {"fail": 0}, "more": "é"}, "note": [1, 2]}],
    "approved": [],
    "rejected": [{"id": 7, "image_bytes": ""}, "odd", {"id": "b", "image_bytes": "?", "result": None}],
}


@pytest.mark.parametrize("indent", [None, 2])
def test_single_file_form_is_read(spark, tmp_path, indent):
    (tmp_path / "applications.json").write_text(json.dumps(REFERENCE, indent=indent), encoding="utf-8")
    rows = {r.id: r for r in read_application_file(spark, str(tmp_path / "applications.json")).collect()}
    a = rows["a"]
    assert (a.brand_name, a.bucket, bytes(a.image_bytes)) == ("Ö & Co", "under_review", b"\x00png")
    assert json.loads(a.app_data) == REFERENCE["under_review"][0]["app_data"]
    assert json.loads(a.result) == REFERENCE["under_review"][0]["result"] and json.loads(a.extra) == {"note": [1, 2]}
    assert (rows["7"].bucket, bytes(rows["7"].image_bytes), rows["7"].extra) == ("rejected", b"", None)
    assert rows["b"].image_bytes is None and len(rows) == 4
    assert unreadable_files(spark, str(tmp_path)).count() == 0


def test_single_file_form_round_trip(spark, tmp_path):
    texts = spark.createDataFrame([(json.dumps(REFERENCE),), ("{broken",), ("[]",), (None,)], "value string")
    entries = parse_documents(texts).where("id is not null")
    write_application_file(entries, str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*")
    form = json.loads(file.read_text(encoding="utf-8"))
    assert list(form) == S.BUCKETS and form["approved"] == [] and len(form["rejected"]) == 2
    (a,) = form["under_review"]
    assert a == REFERENCE["under_review"][0]
    # an image that was no base64 is written as none
    assert form["rejected"][1] == {**REFERENCE["rejected"][2], "id": "b", "image_bytes": "", "brand_name": None, "class_type": None,
                                   "overall_status": None, "app_data": None}
    again = read_application_file(spark, str(file)).where("id <> 'b'")
    assert {tuple(map(str, r)) for r in again.collect()} == {tuple(map(str, r)) for r in entries.where("id <> 'b'").collect()}


def test_missing_and_unreadable_files(spark, tmp_path):
    assert read_application_file(spark, str(tmp_path / "absent.json")).count() == 0
    (tmp_path / "x.json").write_text('{"under_review": [')
    assert read_application_file(spark, str(tmp_path)).count() == 0
    assert [r.file.rsplit("/", 1)[1] for r in unreadable_files(spark, str(tmp_path)).collect()] == ["x.json"]


def test_empty_store_is_written_as_empty_buckets(spark, tmp_path):
    write_application_file(spark.createDataFrame([], S.STORE_SCHEMA), str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*")
    assert json.loads(file.read_text()) == {b: [] for b in S.BUCKETS}
