"""Operators that relate rows to one another, against brute force."""

from __future__ import annotations

import hashlib
import random
import struct
import zipfile
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexkeel.llm import chat, graph, hnsw, simhash, warc
from lexkeel.llm.common import new_path

from .conftest import SCHEMA, sample_texts

# ---- SimHash ----


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, radius=2):
    """``(doc_id, fingerprint)`` rows to the smallest id reachable of each fingerprint."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                root[top(a)] = top(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return {f: least.get(top(f)) for f in fps}


def test_simhash_query(spark, docs, rows, write):
    got = simhash.op4(spark, write(documents=docs)).collect()
    pairs = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    comp = brute_components(pairs)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((i, f"{f:016x}", comp[f]) for i, f in pairs)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("spread", [3, 6, 64])
def test_links_lose_nothing(spark, spread):
    """Dense groups and sparse ones."""
    rng = random.Random(spread)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = [rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(spread if spread < 64 else 2))) & (2**64 - 1) for _ in range(400)]
    pairs = list(enumerate(fps))
    made = spark.createDataFrame([(i, signed(f)) for i, f in pairs], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(made).collect()}
    comp = brute_components(pairs)
    assert got == {i: comp[f] for i, f in pairs}


def brute_pairs(fps):
    return {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2}


def test_cells_list_every_near_pair():
    """Every pair of bits, and every single bit, on fingerprints of either weight."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(4)] + [0, 2**64 - 1]
    cells = lambda x: set(simhash.cells_of(np.array([signed(x)]))[0].tolist())
    for x in base:
        own = cells(x)
        for i in range(64):
            for j in range(i, 64):
                y = x ^ (1 << i | 1 << j)
                assert own & cells(y), (x, i, j)


def test_pivot_rows_are_hamming_distances():
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(50)]
    got = simhash.distances(np.array([signed(f) for f in fps]))
    pivots = [p & (2**64 - 1) for p in simhash.PIVOTS]
    assert got.tolist() == [[(f ^ p).bit_count() for p in pivots] for f in fps]


@pytest.mark.parametrize("kind", ["uniform", "clustered"])
def test_links_are_all_near_pairs(spark, kind):
    rng = random.Random(kind)
    base = [rng.getrandbits(64) for _ in range(200 if kind == "uniform" else 3)]
    near = [x ^ 1 << rng.randrange(64) ^ (1 << rng.randrange(64)) for x in base]
    dense = [b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for b in base for _ in range(400)] if kind == "clustered" else []
    fps = sorted({*base, *near, *dense})
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = [(r["u"], r["v"]) for r in simhash.links(nodes).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(fps)
    t = simhash.tally(nodes).first()
    assert t["verified"] == len(got) and t["listed"] - t["discarded"] >= t["verified"]
    # What the pivots leave is near but for a few pairs at four bits.
    assert t["listed"] - t["discarded"] <= 1.2 * t["verified"] + 5


def test_one_of_each(spark, docs, rows):
    comp = brute_components([(i, brute_fingerprint(t)) for i, t, *_ in rows])
    keep = {i for i, t, *_ in rows if i is not None and comp[brute_fingerprint(t)] == i}
    got = Counter(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert got == Counter({i: 1 for i in keep} | {None: 2})


def test_simhash_edges(empty, clashing, rows):
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.near_duplicates(clashing).count() == len(rows)
    assert simhash.one_of_each(clashing).columns == clashing.columns


def test_stars_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "u long, v long")
    got = {r["u"]: r["v"] for r in graph.stars(edges, "test").collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


# ---- WARC ----

PAGES = "page_id long, url string, html string"


def page_rows():
    long, short = "<p>é漢</p>" * 60, "<p>tiny</p>"
    return [
        (5, "http://a/1", long), (3, "http://a/2", long), (9, None, long), (4, "http://a/\r\nInjected: 1", short), (1, "http://a/3", short),
        (7, "http://a/4", None), (8, "http://a/5", ""), (2, "u", "x" * 99), (6, "u", "x" * 99), (10, "u", "y" * 100), (11, "u", "y" * 100),
        (3, "http://a/2", long), (12, "u", "line\r\n\r\nline" * 50_000), (None, "u", long), (None, "u", "z" * 500),
    ]


def brute_pages(rows):
    least = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            least[b] = min(i, least.get(b, i))
    out = Counter()
    n = Counter((h or "").encode() for _, _, h in rows)
    for i, _, h in rows:
        b = (h or "").encode()
        again = b in least and n[b] > 1 and i != least[b]
        out[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", least[b] if again else None)] += 1
    return out


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_round_trip(spark, zip64, monkeypatch):
    monkeypatch.setattr(warc, "_READ_BYTES", 400)
    rows = page_rows()
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3), zip64).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == brute_pages(rows)
    by_id = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r["payload"]) == by_id[r["page_id"]] for r in got if r["record_type"] == "response" and r["page_id"] is not None)
    assert all(r["payload"] is None for r in got if r["record_type"] == "revisit")


def test_warc_query_and_sql(spark, write):
    at = write(pages=spark.createDataFrame([r for r in page_rows() if r[0] is not None], PAGES))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet/*.parquet'")
    want = con.execute(warc.OP5_SQL)
    names = [c[0] for c in want.description]
    assert Counter(tuple(r[n] for n in names) for r in warc.op5(spark, at).collect()) == Counter(want.fetchall())


def test_packages_are_plain_zip_files(spark):
    to = new_path(spark, "warc-test")
    manifest = warc.write_archives(warc.plan_revisits(spark.createDataFrame(page_rows(), PAGES).coalesce(1)), to).collect()
    for m in manifest:
        with zipfile.ZipFile(m["path"]) as z:
            assert z.testzip() is None
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


@pytest.mark.parametrize("zip64", [False, True])
def test_members_of_any_package(tmp_path, zip64):
    path, data = tmp_path / "a.zip", {"a": [b"123", b"45"], "dir/é": [b""], "c": [b"PK\5\6" * 9]}
    with path.open("wb") as f:
        p = warc.Package(f, zip64)
        for name, parts in data.items():
            p.add(name, parts)
        p.close()
    with zipfile.ZipFile(path, "a") as z:
        z.comment = b"a comment with PK\5\6 in it"
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
    raw = path.read_bytes()
    got = warc.members(lambda at, n: raw[at : at + n], len(raw))
    assert {k: raw[a : a + n] for k, (a, n) in got.items()} == {k: b"".join(v) for k, v in data.items()}
    with pytest.raises(ValueError, match="no end"):
        warc.members(lambda at, n: raw[at : at + n], 10)


def test_zip64_offsets_are_read():
    """A directory whose 32-bit fields all overflow."""
    import io

    out = io.BytesIO()
    p = warc.Package(out, True)
    p.add("m", [b"abc"])
    p.close()
    raw = out.getvalue()
    assert struct.pack("<L", 0xFFFFFFFF) in raw[-22:]
    assert warc.members(lambda at, n: raw[at : at + n], len(raw))["m"][1] == 3


def test_damage_is_noticed():
    raw = warc.record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(raw)


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


# ---- HNSW ----

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_nearest(rows, k, every=50):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            s = sorted(((-float(x @ q / (np.linalg.norm(x) * np.linalg.norm(q))), j) for j, x in ok if j != i and len(x) == len(q)))
            out[i] = [(j, -c) for c, j in s[:k]]
    return out


def recall(got, want):
    hit = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    return hit / max(1, sum(map(len, want.values())))


def nearest_by_query(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("shard_rows", [300, 10_000])
def test_hnsw_recall(spark, shard_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32))
    x = (centres[rng.integers(12, size=1500)] + 0.5 * rng.normal(size=(1500, 32))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS)
    p = hnsw.Hnsw(shard_rows=shard_rows)
    got = nearest_by_query(hnsw.nearest(hnsw.build_index(df, 5, p), hnsw.query_blocks(df.where("vec_id % 50 = 0"), p), 5, p))
    want = brute_nearest([(i, v) for i, v, _ in rows], 5)
    assert set(got) == set(want)
    assert recall(got, want) >= 0.95
    for i, found in got.items():
        exact = dict(want[i])
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(s - exact[j]) < 1e-12 for j, s in found if j in exact)


def test_hnsw_ties_copies_and_unusable_vectors(spark, write):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, hot, 0) for i in range(100, 220)] + [(i, rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(1, 40)]
    rows += [(0, hot, 0), (50, None, 0), (250, [0.0] * 8, 0), (300, [float("nan")] + [1.0] * 7, 0), (350, [None] + [1.0] * 7, 0), (400, [float("inf")] + [1.0] * 7, 0), (100, hot, 0), (None, hot, 0)]
    got = nearest_by_query(hnsw.op7(spark, write(embeddings=spark.createDataFrame(rows, VECTORS))))
    want = brute_nearest([(i, v) for i, v, _ in rows if not (i == 100 and v is None)], 5)
    assert set(got) == {0, 100, 150, 200}
    assert [j for j, _ in got[0]] == [100, 101, 102, 103, 104]
    assert [j for j, _ in got[100]] == [0, 101, 102, 103, 104]
    assert [j for j, _ in got[150]] == [0, 100, 101, 102, 103] or [j for j, _ in want[150]][:1] == [0]


def test_hnsw_few_candidates(spark, write):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [0.0, 1.0], 0)]
    got = nearest_by_query(hnsw.op7(spark, write(embeddings=spark.createDataFrame(rows, VECTORS))))
    assert [j for j, _ in got[0]] == [1, 2]
    assert hnsw.op7(spark, write(embeddings=spark.createDataFrame([], VECTORS))).collect() == []


# ---- chat ----

TURNS = "conv_id long, turn long, role string, text string, node string"


def conversation_rows():
    rng, said = random.Random(8), sample_texts(8)[:8]
    rows = []
    for c in range(60):
        shared = rng.randrange(3)
        turns = [said[j] for j in range(shared)] + [rng.choice(said) for _ in range(rng.randrange(1, 4))]
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", x, "n") for t, x in enumerate(turns)]
    rows += [(c, t, r, x, "n") for c in range(100, 130) for t, r, x in ((0, "system", "same"), (1, "user", "same"), (2, "assistant", "same"))]
    rows += [(200, 0, "user", None, "n"), (200, 1, "assistant", None, "n"), (201, 0, None, "<turn user>\n</turn>\n\\", "n"), (201, None, "assistant", "\\<", "n"), (202, 3, "assistant", "a", "n"), (202, 3, "assistant", "a", "n"), (203, 1, "we<ird>\\\n", "é😀", "n")]
    rows += [(204, t, "assistant", f"turn {t}", "n") for t in range(150)]
    return rows


def brute_conversations(rows):
    by = defaultdict(list)
    for c, t, r, x, *_ in [*rows, (-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)]:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    out = set()
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.add((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.format_turn(r, x)[0]) for _, r, x in turns)))
    return out


def test_chat_query_and_sql(spark, write):
    rows = conversation_rows()
    at = write(conversations=spark.createDataFrame(rows, TURNS).repartition(3))
    got = chat.op10(spark, at)
    assert {tuple(r) for r in got.collect()} == brute_conversations(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/conversations.parquet/*.parquet'")
    want = con.execute(chat.OP10_SQL)
    names = [c[0] for c in want.description]
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(want.fetchall())


def test_chat_tree_is_depth_first_and_emits_once(spark):
    rows = conversation_rows()
    nodes, turns = chat.tree(spark.createDataFrame(rows, TURNS))
    stream = sorted(nodes.collect(), key=lambda r: r["start"])
    assert [r["start"] for r in stream] == [0, *[r["end"] for r in stream[:-1]]]  # gapless
    assert len({r["node"] for r in stream}) == len(stream)
    at = {r["node"]: r for r in stream}
    paths = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r["conv_id"], r["depth"])):
        paths[r["conv_id"]].append(r["node"])
    assert {n for p in paths.values() for n in p} == set(at)
    stack = []
    parent = {n: (p[i - 1] if i else None) for p in paths.values() for i, n in enumerate(p)}
    for r in stream:  # a node follows its parent with nothing but that parent's subtree between
        while stack and stack[-1] != parent[r["node"]]:
            stack.pop()
        assert (stack[-1] if stack else None) == parent[r["node"]]
        assert r["position"] == sum(at[n]["end"] - at[n]["start"] for n in stack)
        stack.append(r["node"])
    shared = Counter(n for p in paths.values() for n in p)
    assert max(shared.values()) >= 30


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("ab<>\\/turn \n")), st.text(st.sampled_from("<>\\/turn \nuser")))))
def test_template_is_reversible(turns):
    assert chat.parse("".join(chat.format_turn(r, t)[0] for r, t in turns)) == turns


def test_template_rejects_other_text():
    with pytest.raises(ValueError, match="no turn"):
        chat.parse("<turn user>\nhi</turn>\nrest")


def test_chat_empty(spark):
    nodes, turns = chat.tree(spark.createDataFrame([], TURNS))
    assert chat.read_back(chat.attention(nodes, turns)).collect() == []
