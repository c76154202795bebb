"""Operators that treat each text on its own, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexkeel.llm import bpe, licenses, packing, pii, quality, toxicity

from .conftest import SCHEMA, sample_texts


def collected(df):
    return [r.asDict() for r in df.collect()]


def by_row(df, *key):
    return Counter(tuple(r[k] for k in key) for r in df.collect())


# ---- byte-level BPE ----


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 1_024), (64, 32), (50, 8)])
def test_bpe_equals_tiktoken_and_round_trips(docs, rows, chunk, overlap):
    enc = bpe.encoding(bpe.default_ranks())
    got = bpe.decode(bpe.encode(docs, keep=["doc_id", "n_chars"], chunk=chunk, overlap=overlap))
    want = Counter((i, n, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _, _, n in rows)
    assert Counter((r["doc_id"], r["n_chars"], bytes(r["ids"]), bytes(r["bytes"])) for r in got.collect()) == want


def test_bpe_query(spark, docs, rows, write):
    enc = bpe.encoding(bpe.default_ranks())
    got = bpe.op2(spark, write(documents=docs))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = Counter()
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert by_row(got, *got.columns) == want


def test_bpe_edges(empty, clashing, rows):
    assert bpe.encode(empty).collect() == []
    assert bpe.decode(bpe.encode(clashing, chunk=64, overlap=32)).count() == len(rows)


# ---- quality rules ----


def measured(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    cover = {i + d for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), len(lines)


def test_quality_measurements_and_verdicts(spark, docs, rows, write):
    got = quality.op3(spark, write(documents=docs))
    want = Counter()
    for i, t, *_ in rows:
        n, chars, symbols, dup, rep, lines = measured(t)
        base = n < 50 or 100 * rep > 50 * n
        want[(i, n, chars, symbols, dup, rep, base, not (base or 100 * symbols > 10 * n or 100 * dup > 50 * lines or not 2 * n <= chars <= 14 * n))] += 1
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == want


def test_quality_runs_no_python(docs):
    plan = quality.apply_policy(quality.ledger(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Window|Aggregate", plan)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=14), min_size=1, max_size=6))
def test_repeated_windows(spark, texts):
    made = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.measure(made).coalesce(1).collect()}
    assert got == {i: measured(" ".join(t))[4] for i, t in enumerate(texts)}


def test_ablation_counts_by_bits(docs):
    led = quality.ledger(docs)
    failed = [r["failed"] for r in led.collect()]
    mask = quality.POLICIES[2]
    for r in collected(quality.ablation(led, 2)):
        bit = 1 << quality.RULES.index(r["rule"])
        assert r["rows"] == len(failed)
        assert r["kept"] == sum(f & mask == 0 for f in failed)
        assert r["n_failed"] == sum(f & bit != 0 for f in failed)
        assert r["n_failed_alone"] == (sum(f & mask == bit for f in failed) if mask & bit else 0)
        assert r["n_kept_without"] == sum(f & mask & ~bit == 0 for f in failed)


def test_quality_edges(empty, clashing, rows):
    assert quality.apply_policy(quality.ledger(empty)).collect() == []
    assert quality.apply_policy(quality.ledger(clashing)).count() == len(rows)
    assert {r["rows"] for r in quality.ablation(quality.ledger(empty)).collect()} == {0}


# ---- packing ----


def test_packing_pieces(spark, docs, rows, write):
    tok = packing.Words(packing.default_tokenizer()).tok
    got = packing.op6(spark, write(documents=docs)).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids, start = [*tok.encode(t or "", add_special_tokens=False).ids, 2], 0
        for n in packing.lengths(len(ids)):
            want[(i, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids))] += 1
            start += n
        assert start == len(ids)
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert all(r["offset"] == 0 and r["length"] == 1 << r["bucket"] <= 4096 and r["sequence_id"] >> 59 == r["bucket"] for r in got)


@given(st.integers(0, 10_000_000))
def test_lengths_are_powers_of_two_that_add_up(n):
    parts = list(packing.lengths(n))
    assert sum(parts) == n
    assert all(p & (p - 1) == 0 and p <= 4096 for p in parts)
    assert parts == sorted(parts, reverse=True)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_remembered_words_equal_the_tokenizer(text):
    words = packing._words(packing.default_tokenizer())
    assert np.frombuffer(words.ids(text), "<u4").tolist() == words.tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from([chr(c) for c in range(0x20, 0x250)] + ["\n", "\t", "–", "“", "€"]), max_size=60))
def test_remembered_latin_words_equal_the_tokenizer(text):
    test_remembered_words_equal_the_tokenizer.hypothesis.inner_test(text)


def test_packing_edges(empty, clashing):
    assert packing.pack(empty).collect() == []
    assert packing.pack(clashing).count() > 0


# ---- toxicity ----


def toxic_corpus(spark, n=400, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 6))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = rng.choices(vocab, k=rng.randrange(1, 300))
        if bad:
            words[rng.randrange(len(words)) : 0] = [rng.choice(["Vile", "rotten", "vermin"])]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, b) for i, _, b in labels)


def test_toxicity_held_out(spark, write):
    docs, labels, truth = toxic_corpus(spark)
    got = toxicity.op1(spark, write(documents=docs, labels=labels)).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_toxicity_never_learns_from_the_held_out_fold(spark):
    docs, labels, truth = toxic_corpus(spark, 120)
    turned = spark.createDataFrame([(i, 1, 1 - b if zlib.crc32(str(i).encode()) % 5 == 0 else b) for i, b in truth.items()], "doc_id long, quality int, toxic int")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (a[0] == b[0]).all()
    assert (a[1] == b[1]).all()


def test_toxicity_features_and_sparsity():
    words = ["a", "b", "c", "d", "a", "b"]
    h = toxicity.WordHashes()(words)
    idx, of = toxicity.features(h, np.array([0, 0, 0, 0, 1, 1]), 20)
    # 6 words; pairs inside documents: 3 + 1 adjacent, 2 with one word between, 1 with two
    assert len(idx) == 6 + 4 + 2 + 1
    assert sorted(idx[of == 1]) == sorted(set(toxicity.text_features(["a b"], 20, toxicity.WordHashes())[0]))
    rows = toxicity.text_features(sample_texts(40), 20, toxicity.WordHashes())
    at, _ = toxicity.fit(rows, np.arange(len(rows)) % 2.0, toxicity.Ftrl())
    assert len(at) < len(np.unique(np.concatenate(rows))) / 2


def test_toxicity_edges(spark, docs, empty, clashing, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {toxicity.PRIOR}
    some = spark.createDataFrame([(i, None, v) for i, v in ((1, 1), (1, 0), (3, None), (21, 0), (None, 1))], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, some)
    scored = toxicity.score(clashing, model)
    assert scored.count() == len(rows)
    assert scored.columns.count("score") == 1
    assert toxicity.score(empty, model).collect() == []


# ---- licenses ----


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def license_rows():
    full = licenses.TEMPLATES[1][1]
    gpl = licenses.TEMPLATES[4][1]
    words = full.split()
    return [
        (1, "pad " * 30 + "Licensed under CC BY-NC 4.0." + " pad" * 30),
        (2, gpl.upper() + " and the MIT-License, Apache license; mit license mit license"),
        (3, " ".join(words[:20] + ["really"] + words[20:])),
        (4, " ".join(words[:6])),
        (5, "the license of a general public"),
        (6, ("x y " + gpl + ". ") * 3),
        (7, None),
        (8, ""),
        (9, "mit"),
        (2, "another text under the same id"),
        (1, "pad " * 30 + "Licensed under CC BY-NC 4.0." + " pad" * 30),
        (None, gpl),
    ]


def brute_labels(text):
    """Labels by comparing every template with every window of its length, word by word."""
    w, out = license_words(text), set()
    for label, template in licenses.TEMPLATES:
        t = license_words(template)
        grams = {}
        for i in range(len(t) - licenses.K + 1):
            grams.setdefault(tuple(t[i : i + licenses.K]), []).append(i)
        votes = {}
        for p in range(len(w) - licenses.K + 1):
            for a in grams.get(tuple(w[p : p + licenses.K]), ()):
                votes.setdefault(p - a, set()).add(a)
        group, last = set(), None
        for d in [*sorted(votes), None]:
            if last is not None and (d is None or d - last > licenses.SLACK):
                n = len({a + j for a in group for j in range(licenses.K)})
                if n >= licenses.SHARE * len(t) or n >= licenses.WORDS:
                    out.add(label)
                group = set()
            if d is not None:
                group |= votes[d]
                last = d
    return out


def test_licenses(spark, write, rows):
    made = license_rows() + [(100 + (i or 0), t) for i, t, *_ in rows[:20]]
    got = licenses.op8(spark, write(documents=spark.createDataFrame(made, "doc_id long, text string"))).collect()
    want = Counter()
    for i, t in made:
        w = license_words(t)
        at = [(j, label) for p, label in licenses.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        base = {x for _, x in at}
        want[(i, len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted(base)), ",".join(sorted(base | brute_labels(t))))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in got) == want
    assert all(0 <= r["score"] <= 1 for r in got)


def test_license_spans(spark):
    made = spark.createDataFrame(license_rows(), "doc_id long, text string")
    spans = {(r["doc_id"], r["label"]): r for r in licenses.scan(made).collect()}
    assert spans[(3, "mit")]["first_word"] == 0
    assert spans[(3, "mit")]["end_word"] == len(license_words(licenses.TEMPLATES[1][1])) + 1  # the inserted word is inside
    assert spans[(1, "cc-by-nc")]["first_word"] == 30
    assert (4, "mit") not in spans


def test_license_edges(empty, clashing):
    assert licenses.scan(empty).collect() == []
    assert licenses.labelled(empty).collect() == []
    assert licenses.labelled(clashing).count() == clashing.count()


# ---- PII ----

PII = [
    "mail a.b+c@x-y.example.com, or x@y @z. d@e.f_g@h.ij end.34@mail7.example.com tail",
    "ip 1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 300.2.3.4.5 10.0.0.1",
    "card 4539 1488 0343 6467 and 4539-1488-0343-6467, 4539148803436468 12345678901234567890 4 5",
    "call +1 (017) 555-7713 or +49.30.1234567x +1 2 +123456789012345678 ++1-23456789",
    "iban DE89370400440532013000 and DE89370400440532013001 GB82WEST12345698765432",
    "aé漢😀 x@y.zz 😀 +1 (017) 555-7713 card 4539148803436467 a@1.2.3.4",
    "a" * 3000 + "@" + "b" * 3000 + "." + "c" * 10,
    "1" * 20_000 + ".2.3.4 " + "1 " * 5000,
    " ".join(f"u{i}@h{i}.com" for i in range(300)),
    "%" * 5000,
    "+" + "-" * 5000 + "1",
]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in pii.PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split(".")) if len(m[0]) < 4000 else False
            elif kind == "card":
                ok = 16 <= len(d) <= 19 and luhn(d)
            elif kind == "phone":
                ok = 8 <= len(d) <= 15
            elif kind == "iban":
                ok = int("".join(str(int(c, 36)) for c in m[0][4:] + m[0][:4])) % 97 == 1
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_equals_the_plain_patterns(spark, write, rows):
    made = [(i, t) for i, t in enumerate(PII)] + [(100 + (i or 0), t) for i, t, *_ in rows]
    got = pii.op9(spark, write(documents=spark.createDataFrame(made, "doc_id long, text string")))
    assert not re.search("Python|Arrow", got._jdf.queryExecution().executedPlan().toString())
    text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = Counter()
    for i, t in made:
        spans = brute_spans(t)
        base = [s for s in spans if s[0] in pii.BASE_KINDS]
        n = Counter(s[0] for s in spans)
        want[(i, *(n[k] for k in pii.BASE_KINDS), hashlib.sha256(text(base).encode()).hexdigest(), text(spans))] += 1
    assert by_row(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans") == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("a1.@-+ 4(%_é"), max_size=40), min_size=1, max_size=30))
def test_pii_on_odd_strings(spark, texts):
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find(made).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_pii_context_is_whole_words_on_both_sides(spark):
    """Neither "ship" nor "latest" is a context word; words behind a span count; words beyond the window or cut by it don't."""
    far = " x" * 30
    cases = [
        ("the latest hotel ship 10.0.0.1", 0.6), ("host 10.0.0.1", 0.7), ("10.0.0.1 is the host", 0.7), ("version test 10.0.0.1", 0.4), ("10.0.0.1 (sample)", 0.4), ("test host 10.0.0.1", 0.5),
        (f"host {far} 10.0.0.1", 0.6), (f"10.0.0.1 {far} host", 0.6), ("ship " + "y" * 37 + " 10.0.0.1", 0.6), ("10.0.0.1 " + "y" * 37 + " iph", 0.6), ("IP: 10.0.0.1", 0.7), ("ip10.0.0.1", 0.7), ("хост-test-10.0.0.1", 0.4), ("éip 10.0.0.1", 0.6), ("a@b.example.com 10.0.0.1", 0.6),
    ]
    made = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [(r["text"], next(s["score"] for s in r["spans"] if s["kind"] == "ip")) for r in pii.find(made).orderBy("doc_id").collect()] == cases
    cleaned = [r["text"] for r in pii.redact(made).orderBy("doc_id").collect()]
    assert cleaned == [t if score < pii.LEAST else t.replace("10.0.0.1", "<IP>").replace("a@b.example.com", "<EMAIL>") for t, score in cases]


def test_pii_many_spans_in_one_text(spark):
    n = 40_000
    text = " ".join(f"u{i}@mail{i % 7}.example.org ü" for i in range(n))
    made = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    made.count()
    began = time.time()
    spans = pii.find(made).select("spans").first()["spans"]
    assert [(s["start"], s["end"]) for s in spans] == [m.span() for m in re.finditer(pii.PLAIN["email"], text)]
    assert pii.redact(made).first()["text"] == re.sub(pii.PLAIN["email"], "<EMAIL>", text)
    assert time.time() - began < 60


def test_pii_redact_keeps_a_column_named_spans(spark):
    made = spark.createDataFrame([("a@b.cd +1 234 567 8901", "own"), (None, None)], "text string, spans string")
    assert [tuple(r) for r in pii.redact(made).collect()] == [("<EMAIL> <PHONE>", "own"), (None, None)]


def test_pii_unions_over_blocks(spark):
    """Overlapping spans of several kinds and cuts on the borders of blocks."""
    card = "4539148803436467"
    pad = pii._BLOCK - 6
    texts = ["é" * pad + " " + card + " " + "z" * (2 * pii._BLOCK) + " a@b.cd", "+" + card[:12] + " x", card + "@b.cd tail", "q" * pii._BLOCK + " a@b.cd"]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r["text"] for r in pii.redact(made).orderBy("doc_id").collect()]
    assert got == ["é" * pad + " <CARD> " + "z" * (2 * pii._BLOCK) + " <EMAIL>", "<PHONE> x", "<CARD> tail", "q" * pii._BLOCK + " <EMAIL>"]


def test_pii_context_adjusts_the_score(spark):
    made = spark.createDataFrame([(1, "your card 4539148803436467"), (2, "4539148803436467"), (3, "test 4539148803436467")], "doc_id long, text string")
    assert [r["spans"][0]["score"] for r in pii.find(made).orderBy("doc_id").collect()] == [0.9, 0.8, 0.6]


def test_redaction(spark, rows):
    made = [(i, t) for i, t in enumerate(PII)] + [(100 + (i or 0), t) for i, t, *_ in rows]
    got = pii.redact(spark.createDataFrame(made, "doc_id long, text string"))
    assert got.columns == ["doc_id", "text"]
    want = Counter()
    for i, t in made:
        if t is None:
            want[(i, None)] += 1
            continue
        out, at, merged = [], 0, []
        for a, b, k in sorted((a, b, k) for k, a, b in brute_spans(t)):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b, k])
        for a, b, k in merged:
            out += [t[at:a], f"<{k.upper()}>"]
            at = b
        want[(i, "".join(out) + t[at:])] += 1
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want


def test_pii_edges(empty, clashing):
    assert pii.find(empty).collect() == []
    assert pii.redact(clashing).count() > 0


def test_sql_of_quality(spark, docs, write):
    con = duckdb.connect()
    at = write(documents=docs)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    want = con.execute(quality.OP3_SQL)
    names = [c[0] for c in want.description]
    assert by_row(quality.op3(spark, at), *names) == Counter(want.fetchall())
