"""Prefix trie, WARC captures and turn repair against brute-force forms, with nulls, ties, repeats, long groups, empty tables and clashing columns."""

import gzip
import hashlib
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from windrow.llm import prefix_trie, queries, turn_repair, warc
from windrow.llm.scans import COUNT, running

TURNS = "conv_id long, turn long, role string, text string"
CLASH = ["position", "digest", "depth", "node", "_pid", "_kind", "base", "end", "done", "code", "tie", "pair", "size", "copied", "page", "record_id", "kind"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def saved(spark, df, tmp_path, name):
    df.select("*", *[F.lit(7).alias(c) for c in CLASH]).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# ---------------------------------------------------------------- running folds


@pytest.mark.parametrize("descending", [False, True])
def test_running_numbers_rows_of_groups_cut_over_tasks(spark, descending):
    rows = [(None if i % 7 == 0 else 5 if i % 3 else i, i) for i in range(500)]
    df = running(spark.createDataFrame(rows, "g long, o long"), "g", ["o"], COUNT, "test", descending)
    want = {}
    for g in {g for g, _ in rows}:
        for n, o in enumerate(sorted((o for h, o in rows if h == g), reverse=descending), 1):
            want[g, o] = (n, n - 1)
    assert {(r.g, r.o): (r.position, r.position_before) for r in df.collect()} == want


# ---------------------------------------------------------------- prefix trie


def brute_trie(rows):
    """Rows of the trie query, node by node from Python dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, bytes.fromhex(sha(f"{len(role)}:{role}{text}")), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, of in members.items():
        below = [n for n in members if n[:len(node)] == node]
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[:-1] == n for m in below)]
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), sum(len(m) == len(node) + 1 for m in below), len(childless),
                    sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), sha(",".join(map(str, sorted(c for c in of if len(rebuilt[c]) == len(node)))))))
    return sorted(out, key=repr)


def conversations():
    r = random.Random(3)
    words = ["Yes.", "No", "Why?", "", "é🙂!", " "]
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(words)) for c in [*range(0, 14), 100, 101, 107, -5, -150, 203] for t in range(r.randrange(0, 9))]
    rows += [(2, 1, "user", "tie"), (2, 1, "user", "tie"), (2, None, "system", "first"), (2, None, None, None), (None, 0, "user", "nobody"), (300, 0, "user", "x" * 30_000)]
    rows += [(400, t, "user" if t % 2 else "assistant", f"long {t}") for t in range(150)] + [(401, t, "user" if t % 2 else "assistant", f"long {t}") for t in range(150)]
    return rows


def test_trie_equals_brute_force(spark, tmp_path):
    rows = conversations()
    got = queries.op11_prefix_trie(spark, saved(spark, spark.createDataFrame(rows, TURNS).repartition(3), tmp_path, "conversations"))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(rows)


def test_trie_of_an_empty_table_has_no_rows(spark, tmp_path):
    assert queries.op11_prefix_trie(spark, saved(spark, spark.createDataFrame([], TURNS), tmp_path, "conversations")).count() == 0


def test_subtree_sums_of_any_forest(spark):
    r = random.Random(8)
    nodes = [(0, None, 1, 5)] + [(i, r.choice([i - 1, i - 1, i - 1, r.randrange(i)]), r.randrange(9), 1) for i in range(1, 120)]  # long chains with branches
    nodes += [(1000, None, 2, 0), (2000, 9999, 3, 0), (2001, 2000, 4, 0)]  # a lone root; a parent that is no node
    up = {i: p for i, p, _, _ in nodes}
    want = {i: [0, 0] for i in up}
    for i, _, a, b in nodes:
        at = i
        while at in up:
            want[at][0] += a
            want[at][1] += b
            at = up[at]
    df = spark.createDataFrame(nodes, "id long, p long, a long, b long")
    assert {x.id: [x.a, x.b] for x in prefix_trie.subtree_sums(df, "id", "p", ["a", "b"]).collect()} == want
    assert prefix_trie.subtree_sums(df.limit(0), "id", "p", ["a", "b"]).count() == 0


def test_id_lists_pass_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_CHUNK", 3)
    rows = [(bytes([k]), i) for k in range(3) for i in range(10 * k + 1)]
    got = prefix_trie.listed_digest(spark.createDataFrame(rows, "node binary, item long"), "node", "item")
    assert {bytes(r.node): r.sha256 for r in got.collect()} == {bytes([k]): sha(",".join(map(str, range(10 * k + 1)))) for k in range(3)}


# ---------------------------------------------------------------- WARC


def brute_pages(rows):
    chief = {}
    for p, _, html in rows:
        chief.setdefault(html or "", []).append(p)
    out = []
    for p, _, html in rows:
        size, known = len((html or "").encode()), [x for x in chief[html or ""] if x is not None]
        first = min(known) if known else None
        whole = size < 100 or p == first
        out.append((p, size, sha(html or ""), "response" if whole else "revisit", None if whole else first))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [True, False])
def test_pages_come_back_from_their_archives(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 100 if broadcast else 0)
    page = "<html>é🙂 " + "x" * 100 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [(5, "https://a.org/x y\r\nZ?q#f", page), (3, None, page), (9, "http://b.org", page), (3, None, page), (None, "u", page), (1, "http://c.org/", "short"), (2, "http://c.org/", "short"),
            (4, "http://d.org", None), (6, "http://d.org", ""), (7, "://", "y" * 100), (8, "x", "y" * 99), (10, "http://e.org", "z" * 2_000_000), (11, "q", "y" * 100), (None, "n", "n" * 200), (None, "n", "n" * 200)]
    got = queries.op12_warc_captures(spark, saved(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), tmp_path, "pages"))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_pages(rows)


def test_no_pages_no_captures(spark, tmp_path):
    assert queries.op12_warc_captures(spark, saved(spark, spark.createDataFrame([], "page_id long, url string, html string"), tmp_path, "pages")).count() == 0


def record(kind, rid, block=b"", **headers):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + rid.encode()]
    lines += [n.replace("_", "-").encode() + b": " + v.encode() for n, vs in headers.items() for v in ([vs] if isinstance(vs, str) else vs)]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = "application/http; msgtype=response"


def archives(folder):
    folder.mkdir()
    answer = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\x00\xff payload"
    member = [record("warcinfo", "w", b"software: x"), record("response", "r1", answer, Content_Type=HTTP, WARC_Concurrent_To=["q1"]), record("request", "q1", b"GET /", Content_Type="application/http")]
    (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in member))  # a member a record, the response names the request
    chain = [record("metadata", "m2", b"k: v", Content_Type="application/warc-fields", WARC_Concurrent_To=["q1"]), record("metadata", "m3", b"", WARC_Concurrent_To=["m2", "nowhere"])]
    lone = [record("request", "q9", b"GET /9", WARC_Concurrent_To="r9", WARC_Target_URI="http://nine"), record("revisit", "r2", b"HTTP/1.1 200 OK\r\n\r\n", Content_Type=HTTP, WARC_Refers_To="r1")]
    (folder / "b.warc").write_bytes(b"".join(chain + lone))  # plain; hops over records of another archive
    (folder / "c.warc").write_bytes(record("response", "r3", answer, Content_Type=HTTP, WARC_Payload_Digest="sha256:" + "0" * 64) + record("response", "r4", b"x" * 50)[:-30])
    (folder / "d.warc.gz").write_bytes(gzip.compress(record("request", "q5", b"x" * 9000))[:-40])
    (folder / "e.warc").write_bytes(b"")


def test_records_of_foreign_archives(spark, tmp_path):
    archives(tmp_path / "w")
    rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
    by = {r.record_id: r for r in rows}
    assert bytes(by["r1"].payload) == b"\x00\xff payload" and by["r1"].payload_sha256 == hashlib.sha256(b"\x00\xff payload").hexdigest() and by["r1"].error is None
    assert by["r3"].error and by["r4"].kind == "damaged" and by["m2"].head == "k: v" and by["m3"].concurrent_to == ["m2", "nowhere"]
    assert sum(r.kind == "damaged" for r in rows) == 2  # r4 and the cut gzip stream


def test_transactions_are_joined_over_hops_and_archives(spark, tmp_path, monkeypatch):
    archives(tmp_path / "w")
    records = warc.read_archives(spark, str(tmp_path / "w")).cache()
    got = {r.capture: r for r in warc.assemble(records).collect()}
    assert set(got) == {"r1", "r2", "r3", "q9"}
    assert [x.record_id for x in got["r1"].requests] == ["q1"] and [x.record_id for x in got["r1"].metadata] == ["m2", "m3"] and got["r1"].response.payload_bytes == 10
    assert got["q9"].response is None and got["q9"].target_uri == "http://nine" and got["r2"].requests == []
    assert {r.capture: r.original for r in warc.originals(warc.assemble(records)).collect()} == {"r2": "r1"}
    monkeypatch.setattr(warc, "NEST", 1)
    parts = [r for r in warc.assemble(records).collect() if r.capture == "r1"]
    assert sorted(x.record_id for r in parts for x in [*r.requests, *r.metadata]) == ["m2", "m3", "q1"] and sum(r.response is not None for r in parts) == 1
    records.unpersist()


# ---------------------------------------------------------------- turn repair


def brute_edits(codes):
    """Least (cost, edits) from the grammar alone, by recursion over every edit."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, inserted):
        out = [(0, "")] if i == len(codes) and last in ("", "a") else []
        asked = [r for r in follow[last] if r != "s"][0]
        if inserted < 4:
            c, e = best(i, asked, inserted + 1)
            out.append((c + 5, "I" + e))
        if i < len(codes):
            code, late = codes[i].lower(), 5 if codes[i].isupper() else 0
            c, e = best(i + 1, last, 0)
            out.append((c + 2, "D" + e))
            if code != "-":
                if code in follow[last]:
                    c, e = best(i + 1, code, 0)
                    out.append((c + late, "K" + e))
                c, e = best(i + 1, asked, 0)
                out.append((c + late + 1, "R" + e))
        return min(out, default=(10**9, ""))

    return best(0, "", 0)


def test_search_finds_the_ascii_least_cheapest_edits():
    r = random.Random(1)
    for _ in range(800):
        codes = "".join(r.choice("suuaaaxSUAX-") for _ in range(r.randrange(0, 12)))
        edits, _, cost = turn_repair.search(codes, 0, turn_repair.closing(), True)
        spent = cost
        assert (spent, edits) == brute_edits(codes), codes


def brute_repair(rows):
    groups, out = {}, []
    for c, turn, role, text in rows:
        groups.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            hurt = ("user" if kind == 4 else role, "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text)
            groups[c] += [((turn is not None, turn or 0, bytes.fromhex(sha(f"{len(role)}:{role}{text}"))), turn, *hurt)] * (1 + (kind == 3))
    for c, turns in groups.items():
        turns.sort(key=lambda x: x[0])
        seen, codes, faults = set(), "", []
        for _, _, role, text in turns:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = brute_edits(codes)
        given = sorted({t for _, t, _, _ in turns if t is not None})
        lines = [f"{role}:{text}" for role, text in turn_repair.repaired([(t[2], t[3]) for t in turns], audit)]
        pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out.append((c, given[-1] - given[0] + 1 - len(given) if given else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], pairs, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [128, 3])
def test_repair_equals_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)  # three rows: nearly every conversation is cut
    r = random.Random(11)
    texts = ["Yes.", "No", "Why?", "", " \t\n", "é🙂! \n", "a.b", "end. ", None, "x" * 20_000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "U", None]
    rows = [(c, t if r.random() < 0.9 else None, r.choice(roles), r.choice(texts) if r.random() < 0.4 else f"Turn {t}.") for c in [*range(40), None, -3] for t in range(r.randrange(1, 12))]
    rows += [(50, 1, "user", "tie."), (50, 1, "user", "tie."), (50, 1, "assistant", "tie")] * 3
    rows += [(60, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(140)]
    got = queries.op13_turn_repair(spark, saved(spark, spark.createDataFrame(rows, TURNS).repartition(3), tmp_path, "conversations"))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute_repair(rows)


def test_repair_of_an_empty_table_has_no_rows(spark, tmp_path):
    assert queries.op13_turn_repair(spark, saved(spark, spark.createDataFrame([], TURNS), tmp_path, "conversations")).count() == 0
