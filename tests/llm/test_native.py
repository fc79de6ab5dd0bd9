"""Line dedup, URL rules, quality rules, shards and preference pairs: odd rows, and queries against SQL."""

from __future__ import annotations

import glob
import os
import random

import duckdb
import numpy as np
import pytest

from logloom.llm import line_dedup, preference, quality, sharding, url_filter
from logloom.llm.oracles import ORACLES
from logloom.llm.queries import QUERIES
from logloom.session import settle

DATA = "/root/testdata/sf0.001"


def as_rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    duck = duckdb.connect()
    for file in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    frame = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert as_rows(frame.columns, frame.collect()) == as_rows(columns, result.fetchall())


def by_oracle(spark, tmp_path, name, table, frame):
    """Rows of the query and of its SQL over one table of odd rows."""
    frame.write.parquet(f"{tmp_path}/{table}.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    found = QUERIES[name](spark, str(tmp_path))
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert as_rows(found.columns, found.collect()) == as_rows(columns, result.fetchall())
    return found


TEXTS = [
    None, "", "\n", "a line that is shared\nan own line, number 1\nA LINE THAT IS SHARED ", "x\n\ta line that is shared\x0b\n\n",
    "short\nshort\nÉcole partagée ici\n", "short\nécole partagée ici\nÉcole partagée ici", "a line that is shared", "own\nown\nown own own",
    "\u00a0a line that is shared", "tail\n\n\n", "ten chars!\nten chars", "ten chars!\nten chars",
]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


ODD = [(i // 2 if i < 8 else i, t, None if i % 5 == 0 else f"s{i % 3}") for i, t in enumerate(TEXTS)] + [(8, TEXTS[8], "s2"), (20, "word " * 30_000 + "\na line that is shared", "s1")]


def test_lines_of_odd_rows(spark, tmp_path):
    by_oracle(spark, tmp_path, "op2_line_dedup", "documents", documents(spark, ODD))


def test_lines_without_ids_and_clashing_columns(spark):
    docs = documents(spark, [(None, "a line that is shared", "x"), (None, "a line that is shared", "y"), (1, "a line that is shared\nmore", "z"), (2, "a line that is shared\nmore", "z")])
    wide = docs.selectExpr("*", "7 AS id", "8 AS row", "9 AS pos", "10 AS N_LINES", "'t' AS text1")
    kept = line_dedup.drop_shared_lines(wide)
    assert kept.columns == [*wide.columns, "n_dropped"]
    assert sorted((r.doc_id or 0, r.text, r.N_LINES, r.n_dropped, r.id) for r in kept.collect()) == [
        (0, "a line that is shared", 1, 0, 7), (0, "a line that is shared", 1, 0, 7), (1, "a line that is shared\nmore", 2, 0, 7), (2, "more", 2, 1, 7),
    ]
    assert line_dedup.drop_shared_lines(docs.limit(0)).count() == 0
    three = documents(spark, [(i, "a line that is shared\nanother line of three" if i else "another line of three", "") for i in range(3)])
    assert [r.text for r in line_dedup.drop_shared_lines(three, min_docs=3).orderBy("doc_id").collect()] == ["another line of three"] + ["a line that is shared"] * 2


def test_random_lines(spark, tmp_path):
    rng = random.Random(3)
    lines = ["", " ", "the same line again", "The Same Line Again", "\tthe same line again", "0123456789", "012345678", "é" * 10, "É" * 10]
    rows = [(rng.randrange(30), "\n".join(rng.choices(lines, k=rng.randrange(1, 9))), "s") for _ in range(60)]
    by_oracle(spark, tmp_path, "op2_line_dedup", "documents", documents(spark, rows))


def test_quality_of_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = list(ODD)
    for i in range(100, 260):
        words = rng.choices(["aa", "bb", "c#", "|", "dd dd", "e\ne", "ünï", "\x0b", "x" * 12], k=rng.randrange(80))
        rows.append((i, " ".join(words), rng.choice(["hot", "hot", "hot", "b", None])))
    found = by_oracle(spark, tmp_path, "op5_domain_quality", "documents", documents(spark, rows))
    assert found.count() == len(rows)


def test_strict_domains_reject_more(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    lined = "\n".join([clean, *["again"] * 9])
    bad = "| " * 30
    rows = [(i, bad, "bad") for i in range(60)] + [(100 + i, lined, "bad") for i in range(3)] + [(200 + i, lined, "good") for i in range(60)] + [(300, clean, "bad"), (301, clean, None)]
    rows += [(400 + i, clean, f"d{i % 4}") for i in range(40)]
    docs = documents(spark, rows).selectExpr("*", "1 AS kept", "2 AS own_domain", "3 AS row")
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {200 + i for i in range(60)} | {300, 301} | {400 + i for i in range(40)}
    assert quality.filter_documents(docs.limit(0)).count() == 0


def test_one_bad_host_among_hosts_of_unequal_sizes(spark):
    """The bad host has a third of all rows; small hosts and those like all others are not strict by chance."""
    rng = random.Random(8)
    clean = " ".join(f"word{i}" for i in range(40))
    lined = "\n".join([clean, *["again"] * 9])
    bad = "| " * 30
    sizes = {"bad": 900, "large": 800, **{f"host{i}": 5 + 12 * i for i in range(10)}, **{f"tiny{i}": 1 + i % 3 for i in range(40)}}
    rows = []
    for host, n in sizes.items():
        rate = 0.6 if host == "bad" else 0.1
        for k in range(n):
            rows.append((len(rows), lined if k == 0 else bad if rng.random() < rate else clean, host))
    rows += [(len(rows), bad, "alone"), (len(rows) + 1, bad, None)]
    counted = settle(quality.with_counts(documents(spark, rows)))
    strict = {r.domain for r in quality.strict_domains(counted).where("strict").collect()}
    assert strict == {"bad"}
    judged = {r.doc_id: r for r in quality.judge(counted).collect()}
    for i, text, host in rows:
        assert judged[i].kept == (text == clean or text == lined and host != "bad")
    # Hosts that are all alike: none stands out.
    alike = [(i, bad if i % 5 == 0 else clean, f"h{i % 7}") for i in range(700)]
    same = quality.strict_domains(settle(quality.with_counts(documents(spark, alike))))
    assert not same.where("strict").count()


def test_urls_of_odd_rows(spark, tmp_path):
    urls = [
        None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x", "https://a.b.example.org/en/1234", "https://example.org/EN/1", "x://y://example.org/es/",
        "http://notexample.org/es/", "http://example.com/fr/1?utm_source=feed", "http://example.net/?page=2&x&ref=", "http://example.net?page=2&REF=y", "http://com/de/",
        "http://example.net/a\nb?page=1\n&ref=", "http://exämple.com/de/ü", "http://org/", "http://org", "ftp://x.org/#a", "http://my site.example.org/es/x", "http://a b/c?://example.org/es/", "http://tab\there.org/es", "http://x.org:80/es/", "http://h.example.org:80/es/1", "http://example.net/UTM_SOURCE", "http://example.net/?utm_source=",
    ]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[5]), (None, urls[6])], "page_id long, url string")
    by_oracle(spark, tmp_path, "op4_url_rules", "pages", pages)


def test_rules_are_found_by_their_rarest_token(spark):
    rules = [
        url_filter.site_rule("example.org", "/es/", "block"), url_filter.site_rule("example.org", "", "allow"), url_filter.pattern_rule("ads*banner", "block"),
        url_filter.pattern_rule("/track/", "block"), url_filter.pattern_rule("?id=", "allow"), url_filter.pattern_rule("*", "allow"), url_filter.pattern_rule("/zzzzz/", "allow"),
    ]
    assert rules[0].tokens == ("example", "org", "es") and rules[2].tokens == () and rules[3].tokens == ("track",)
    urls = ["http://example.org/es/1", "http://x.example.org/", "http://y.net/myads/big-banners/", "http://y.net/track/?id=3", "http://y.net/tracks/", "http://y.net/TRACK/a", None]
    frame = spark.createDataFrame([(u, "v") for u in urls * 3], "url string, verdict string").selectExpr("*", "1 AS text", "2 AS best")
    found = url_filter.judge(frame, url_filter.rule_table(spark, rules))
    assert found.columns == ["url", "verdict", "text", "best", "host", "path", "rule"]
    got = {r.url: (r.rule, r.verdict) for r in found.collect()}
    assert got == {
        urls[0]: ("example.org/es/", "block"), urls[1]: ("example.org", "allow"), urls[2]: ("ads*banner", "block"), urls[3]: ("/track/", "block"),
        urls[4]: ("*", "allow"), urls[5]: ("/track/", "block"), None: ("*", "allow"),
    }
    none = url_filter.judge(frame, url_filter.rule_table(spark, rules).limit(0))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")} and none.count() == 21
    assert url_filter.judge(frame.limit(0), url_filter.rule_table(spark, rules)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation(n):
    numbers = np.arange(n)
    for seed in (0, 42):
        there = sharding.permuted(numbers, n, seed)
        assert sorted(there.tolist()) == numbers.tolist()
        assert sharding.original(there, n, seed).tolist() == numbers.tolist()
    if n > 100:
        assert (sharding.permuted(numbers, n, 1) != sharding.permuted(numbers, n, 2)).any()
        assert abs(np.corrcoef(numbers, sharding.permuted(numbers, n, 1))[0, 1]) < 0.1


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(i % 40 if i % 7 else None, None if i % 11 == 0 else f"t{i % 5}", "s") for i in range(333)]
    docs = documents(spark, rows).selectExpr("*", "1 AS shard", "'x' AS slot")
    sharded = settle(sharding.shuffle_into_shards(docs, 16))
    assert sharded.columns == ["doc_id", "text", "source", "row_number", "shard", "slot"]
    found = sharded.collect()
    assert sorted(r.row_number for r in found) == list(range(333))
    per_shard = {s: sorted(r.slot for r in found if r.shard == s) for s in range(16)}
    assert all(slots == list(range(len(slots))) for slots in per_shard.values())
    assert {len(s) for s in per_shard.values()} == {20, 21}
    again = sharding.shuffle_into_shards(docs.repartition(7), 16).collect()
    place = lambda rs: sorted(((r.doc_id, r.text, r.shard, r.slot) for r in rs), key=str)
    assert place(again) == place(found)
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.row_number)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sharding.shuffle_into_shards(docs.limit(0), 16).count() == 0
    sharding.write_shards(sharded, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 333


def test_shard_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    found = {r.doc_id: r for r in QUERIES["op9_feistel_shards"](spark, DATA).collect()}
    order = sorted(r.doc_id for r in docs)
    place = sharding.permuted(np.arange(len(order)), len(order), 42)
    for i, doc in enumerate(order):
        assert (found[doc].row_number, found[doc].shard, found[doc].slot, found[doc].law) == (i, place[i] % 16, place[i] // 16, "rows")
    assert {d.doc_id: len((d.text or "").encode()) + 1 for d in docs} == {d: r.size for d, r in found.items()}


def test_conversations_of_odd_rows(spark, tmp_path):
    rows = [
        (0, 0, "user", "hello"), (0, 1, "assistant", "hi"), (0, 2, "user", "bye"), (1, 0, "user", "hello"), (1, 1, "assistant", "hi"),
        (2, 0, None, None), (2, None, "assistant", "late"), (2, 3, "user", "é"), (3, 5, "system", "only"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"),
        (5, 1, "assistant", "b"), (5, 1, "assistant", "b"), (None, 0, "user", "lost"), (7, 0, "user", ""), (7, 1, "assistant", None), (9, 2, "assistant", "x"), (8, 0, "user", "q"), (8, 7, "assistant", "y"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pair_id", "'c' AS side")
    by_oracle(spark, tmp_path, "op1_preference_pairs", "conversations", frame)
    empty = preference.conversations_of(frame.limit(0), "conv_id")
    assert preference.format_pairs(preference.side_by_side(empty, empty)).count() == 0
    some = preference.conversations_of(frame, "conv_id")
    alone = preference.format_pairs(preference.side_by_side(some.where("pair_id < 3"), some.where("pair_id > 0"))).collect()
    assert {r.pair_id: (bool(r.prompt), bool(r.chosen), bool(r.rejected)) for r in alone if r.pair_id in (0, 1, 4)} == {
        0: (False, True, False), 1: (True, False, False), 4: (False, False, True),
    }


def test_a_pair(spark):
    schema = "pair_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "good")], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "bad")], schema)
    sides = [preference.conversations_of(t, "pair_id") for t in (chosen, rejected)]
    (row,) = preference.format_pairs(preference.side_by_side(*sides)).collect()
    assert row.prompt == "<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nmore<|end|>\n" and row.prompt_turns == 3
    assert [tuple(s) for s in row.chosen] == [("<|assistant|>\n", False), ("good<|end|>\n", True)]
    assert [tuple(s) for s in row.rejected] == [("<|assistant|>\n", False), ("bad<|end|>\n", True)]
