"""Properties (SURVEY §5 (3)) checked against brute force on random inputs with hot keys."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docfetch.functions import columns as C
from docfetch.operators import browse as B
from docfetch.operators import catalog as CA
from docfetch.operators import prepare as P
from docfetch.operators import runs as RU
from docfetch.operators.keys import flag_extreme_per_key, keep_extreme_per_key

SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

keys = st.sampled_from(["hot", "hot", "hot", "a", "b", "c", None])


@settings(**SETTINGS)
@given(st.lists(keys, min_size=1, max_size=40))
def test_first_per_key_matches_brute_force(spark, ks):
    rows = [(i, k) for i, k in enumerate(ks)]
    df = spark.createDataFrame(rows, "row_no long, k string")
    got = {r.row_no: r.first for r in flag_extreme_per_key(df, ["k"], "row_no", "first").collect()}
    seen, want = set(), {}
    for i, k in rows:
        want[i] = k is None or k not in seen
        if k is not None:
            seen.add(k)
    assert got == want
    last = {r.k: r.row_no for r in keep_extreme_per_key(df, ["k"], "row_no", last=True).collect()}
    assert last == {k: max(i for i, kk in rows if kk == k) for k in set(ks) if k is not None}


@settings(**SETTINGS)
@given(st.lists(st.text(alphabet="ab_#@.xyz1", max_size=8), min_size=1, max_size=30))
def test_validation_partitions_input(spark, names):
    df = spark.createDataFrame([(i, n, f"{n}@ex.org") for i, n in enumerate(names)],
                               "row_no long, username string, email string")
    valid, rejected = P.validate_rows(df, C.account_rules())
    assert valid.count() + rejected.count() == len(names)
    assert valid.join(rejected, "row_no").count() == 0


@settings(**SETTINGS)
@given(st.integers(min_value=1, max_value=7), st.sampled_from(["asc", "desc"]))
def test_pages_partition_the_filtered_set(spark, size, order):
    rows = [(i, f"BR{i:03d}", str(2017 + i % 3) if i % 5 else None, "TRUE" if i % 4 else "FALSE")
            for i in range(23)]
    df = spark.createDataFrame(rows, "id long, brnumber string, publication_year string, download_status string")
    flt = '{"download_status": "TRUE"}'
    total = B.count_matching(df, flt, page_size=size).first()
    seen = []
    for p in range(1, total.total_pages + 1):
        seen += [r.brnumber for r in B.page(B.sort_by(B.filter_equals(df, flt), "publication_year", order),
                                            p, size).collect()]
    assert len(seen) == len(set(seen)) == total.total == sum(1 for r in rows if r[3] == "TRUE")
    assert total.total_pages == math.ceil(total.total / size)
    assert B.page(B.sort_by(B.filter_equals(df, flt), "publication_year", order),
                  total.total_pages + 1, size).count() == 0


@settings(**SETTINGS)
@given(st.lists(st.sampled_from(["K1", "K2", "K3", "K4", "K5"]), min_size=1, max_size=12))
def test_upsert_unique_and_idempotent(spark, ks):
    cat = spark.createDataFrame([(1, "K1", "old"), (2, "K2", "old")], "id long, brnumber string, title string")
    upd = spark.createDataFrame([(i, k, f"t{i}") for i, k in enumerate(ks)], "row_no long, brnumber string, title string")
    once = CA.upsert(cat, upd)
    got = {r.brnumber: r for r in once.collect()}
    assert len(got) == once.count()
    for k in set(ks):
        assert got[k].title == f"t{max(i for i, kk in enumerate(ks) if kk == k)}"
    assert {r.id for r in once.collect()} >= {1, 2} and len({r.id for r in once.collect()}) == len(got)
    twice = CA.upsert(spark.createDataFrame(once.collect(), once.schema), upd)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20000),
                          st.sampled_from(["successful", "already_downloaded", "failed"])),
                min_size=1, max_size=40),
       st.sampled_from([1, 3, 8]))
def test_running_counts_match_brute_force(spark, events, bucket):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(run, i, base + dt.timedelta(seconds=s), o) for i, (run, s, o) in enumerate(events)]
    df = spark.createDataFrame(rows, "run_id long, seq long, finished_at timestamp_ntz, outcome string")
    got = {r.seq: (r.successful, r.already_downloaded, r.failed, r.processed_rows)
           for r in RU.running_counts(df, slices=bucket).collect()}
    want = {}
    for run in {r[0] for r in rows}:
        acc = [0, 0, 0, 0]
        for r in sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], r[1])):
            acc[["successful", "already_downloaded", "failed"].index(r[3])] += 1
            acc[3] += 1
            want[r[1]] = tuple(acc)
    assert got == want
    final = {r.run_id: r for r in RU.outcome_counts(df).collect()}
    for run, r in final.items():
        assert r.successful + r.already_downloaded + r.failed == r.processed_rows


def test_plan_never_fetches_a_true_key(spark):
    from docfetch.fixtures import Fixtures
    from docfetch.registry import plan_v
    fx = Fixtures(spark, "/root/testdata/sf0.01")
    true_keys = fx.catalog_v().where(F.col("download_status") == "TRUE").select("brnumber")
    assert plan_v(fx).where(F.col("decision") == "fetch").join(true_keys, "brnumber").count() == 0


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.sampled_from(["u1", "u2", "u3", None]), st.sampled_from(["e1", "e2", "e3"])),
                min_size=1, max_size=14))
def test_sequential_duplicates_match_one_at_a_time_inserts(spark, pairs):
    rows = [(i, u, e) for i, (u, e) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "row_no long, username string, email string")
    existing = spark.createDataFrame([("u3", "e9")], "username string, email string")
    got = {r.row_no: r.reject_reason for r in P.flag_duplicates_sequential(
        df, ["username", "email"], ["Username already exists", "Email already exists"],
        existing=existing).collect()}
    users, emails, want = {"u3"}, {"e9"}, {}
    for i, u, e in rows:
        if u is not None and u in users:
            want[i] = "Username already exists"
        elif e in emails:
            want[i] = "Email already exists"
        else:
            want[i] = None
            if u is not None:
                users.add(u)
            emails.add(e)
    assert got == want


def test_sequential_duplicates_all_taken_by_existing(spark):
    df = spark.createDataFrame([(0, "u3", "e1")], "row_no long, username string, email string")
    existing = spark.createDataFrame([("u3", "e9")], "username string, email string")
    out = P.flag_duplicates_sequential(df, ["username", "email"], ["U", "E"], existing=existing).collect()
    assert [(r.row_no, r.reject_reason) for r in out] == [(0, "U")]


@settings(**SETTINGS)
@given(st.integers(min_value=1, max_value=6), st.sampled_from(["asc", "desc"]))
def test_keyset_pages_equal_offset_pages(spark, size, order):
    rows = [(i, f"BR{i:03d}", str(2017 + i % 4) if i % 5 else None) for i in range(21)]
    df = spark.createDataFrame(rows, "id long, brnumber string, publication_year string")
    by_offset = []
    p = 1
    while True:
        got = [(r.publication_year, r.brnumber) for r in
               B.page(B.sort_by(df, "publication_year", order), p, size).collect()]
        if not got:
            break
        by_offset += got
        p += 1
    by_key = [(r.publication_year, r.brnumber) for r in
              B.sort_by(df, "publication_year", order).limit(size).collect()]
    while True:
        last_v, last_k = by_key[-1]
        got = [(r.publication_year, r.brnumber) for r in
               B.page_after(df, "publication_year", last_v, last_k, size, order).collect()]
        if not got:
            break
        by_key += got
    assert by_key == by_offset and len(by_key) == 21


def test_upsert_drops_updates_without_a_key(spark):
    cat = spark.createDataFrame([(1, "K1", "old")], "id long, brnumber string, title string")
    upd = spark.createDataFrame([(0, None, "x"), (1, "K1", "new")], "row_no long, brnumber string, title string")
    out = {r.brnumber: r.title for r in CA.upsert(cat, upd).collect()}
    assert out == {"K1": "new"}


def _one_at_a_time(rows):
    """(row_no, user, mail) inserted in order: the positions that are accepted."""
    users, mails, accepted = set(), set(), set()
    for r, u, m in sorted(rows):
        if (u is None or u not in users) and (m is None or m not in mails):
            accepted.add(r)
            users.add(u)
            mails.add(m)
    return accepted


def _sequential(spark, rows, monkeypatch=None):
    calls = []
    if monkeypatch is not None:
        from pyspark.sql.classic.dataframe import DataFrame

        real = DataFrame.checkpoint
        monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: calls.append(1) or real(self, *a, **k))
    df = spark.createDataFrame(rows, "row_no long, username string, email string")
    out = P.flag_duplicates_sequential(df, ["username", "email"], ["U", "E"])
    return {r.row_no for r in out.where("reject_reason is null").collect()}, len(calls)


def test_a_chain_of_blocking_rows_takes_log_rounds(spark, monkeypatch):
    """100,000 rows, each blocked by the one before only: about 17 pointer steps, not 50,000 rounds."""
    n = 100_000
    chain = [(i, f"u{i // 2}", f"m{(i + 1) // 2}") for i in range(n)]
    got, steps = _sequential(spark, chain, monkeypatch)
    assert got == set(range(0, n, 2)) and steps < 40


def test_sequential_duplicates_of_many_shapes(spark):
    """Chains up and down, cycles, stars, hot values and nulls in one batch."""
    import random

    rng = random.Random(6)
    rows, at = [], 0
    for shape in range(60):
        n = rng.randrange(1, 25)
        order = list(range(at, at + n))
        rng.shuffle(order)
        kind = shape % 4
        for j, r in enumerate(order):
            if kind == 0:                                                 # a path in random order
                rows.append((r, f"u{shape}-{j // 2}", f"m{shape}-{(j + 1) // 2}"))
            elif kind == 1:                                               # a cycle
                rows.append((r, f"u{shape}-{j // 2 % (n // 2 + 1)}", f"m{shape}-{(j + 1) // 2 % (n // 2 + 1)}"))
            elif kind == 2:                                               # dense
                rows.append((r, f"u{shape}-{rng.randrange(4)}", f"m{shape}-{rng.randrange(4)}"))
            else:
                rows.append((r, rng.choice([None, f"u{shape}", f"u{shape}-{j}"]), rng.choice([None, f"m{shape}-{j // 3}"])))
        at += n
    got, _ = _sequential(spark, rows)
    assert got == _one_at_a_time(rows)
