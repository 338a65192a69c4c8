import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import suffix_dedup as sd


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - 199):
            if n[b[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(seed=1):
    r = random.Random(seed)
    text = lambda n: "".join(r.choices("abcdefg hijkl mno é\0", k=n))
    passage, line = text(300), text(185)
    rows = [None, "", "x" * 199, "y" * 200, "z" * 201, "w" * 1500, "w" * 900, "ab " * 700, text(150)]
    rows += [text(r.randrange(100, 900)) for _ in range(10)]
    rows += [text(90) + passage + text(120) for _ in range(6)] + [text(40) + passage[:230] + text(50) + passage[100:] for _ in range(3)]
    rows += [text(60) + line + text(60) for _ in range(30)]
    base = text(1200)
    for _ in range(12):
        k = r.randrange(1200)
        rows.append(base[:k] + "Q" + base[k + 1 :])
    rows += [base, base, rows[10], rows[10], "s" * 50, "s" * 50]
    own = text(260)
    rows.append(text(30) + own + text(30) + own)
    return rows


@pytest.mark.parametrize("frequent, shard", [(5000, 2 << 20), (4, 3000)])
def test_report_is_brute_force(spark, monkeypatch, frequent, shard):
    monkeypatch.setattr(sd, "FREQUENT", frequent)
    monkeypatch.setattr(sd, "SHARD", shard)
    monkeypatch.setattr(sd, "SCAN", 5000 if shard == 3000 else sd.SCAN)
    rows = corpus()
    # the parameters reach the workers as part of the functions only if they are pickled by value; so test them here too
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(rows)], "doc_id long, text string, n_chars long").repartition(5)
    want = brute(rows)
    got = {r.doc_id: r for r in sd.repeat_report(df).collect()}
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: w[:4] for i, w in enumerate(want)}
    left = {r.doc_id: r for r in sd.without_repeats(df).collect()}
    for i, w in enumerate(want):
        assert (left[i].text or "") == w[4].decode(errors="ignore")
        assert left[i].n_chars == (None if left[i].text is None else len(left[i].text))


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert sd.repeat_report(spark.createDataFrame([], schema)).count() == 0
    assert sd.without_repeats(spark.createDataFrame([], schema)).count() == 0
    t = "".join(random.Random(1).choices("abcdef ", k=400))
    rows = [(None, t), (3, t[:250] + "!"), (3, "short"), (3, "short"), (None, None), (5, t[100:])]
    got = Counter(tuple(r) for r in sd.repeat_report(spark.createDataFrame(rows, schema)).collect())
    assert got == Counter((i, *w[:4]) for (i, _), w in zip(rows, brute([t for _, t in rows])))


def test_suffix_array_and_prefixes():
    r = random.Random(2)
    for letters, n in (("ab", 500), ("a", 300), ("abcdefgh\0", 2000), ("xyz" * 3, 1), ("\0", 40), ("ab\0", 700)):
        b = "".join(r.choices(letters, k=n)).encode()
        text = np.frombuffer(b, np.uint8)
        sa = sd.suffix_array(text)
        want = sorted(range(n), key=lambda i: b[i:])
        assert sa.tolist() == want, letters
        for lanes in (1, 7, 4096):
            lcp = sd.common_prefixes(text, sa, 50, lanes)
            for k in range(1, n):
                x, y = b[want[k - 1] :], b[want[k] :]
                m = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
                assert lcp[k] == min(m, 50)


def test_leaders_depend_on_windows_alone():
    r = random.Random(3)
    text = "".join(r.choices("abcdef gh", k=3000)).encode()
    h, first, place = sd.runs(np.frombuffer(text, np.uint8), np.array([len(text)]))
    of = {}
    for x, a, b, p in zip(h, first, np.append(first[1:], len(text) - 199), place):
        for s in range(a, b):
            of[text[s : s + 200]] = (x, p - s)
    assert len(of) == len(text) - 199
    for cut in (1, 77, 1500):
        part = np.frombuffer(text, np.uint8)[cut : cut + 900]
        h, first, place = sd.runs(np.concatenate([part, part[:250]]), np.array([900, 1150]))
        for x, a, p in zip(h, first, place):
            s = bytes(np.concatenate([part, part[:250]])[a : a + 200])
            assert of[s] == (x, p - a)


@pytest.mark.parametrize("shard", [400, 1000, 1 << 20])
def test_shards_of_a_leader_are_merged(shard):
    r = random.Random(4)
    core = "".join(r.choices("abc", k=190)).encode()
    pieces = [bytes(r.choices(b"ab", k=9)) + core + bytes(r.choices(b"ab", k=9)) for _ in range(40)]
    pieces = list(dict.fromkeys(pieces))
    times = np.ones(len(pieces), np.int64)
    n = Counter(p[i : i + 200] for p in pieces for i in range(len(p) - 199))
    (masks,) = sd.repeated_in([(pieces, times)], shard)
    assert [m.tolist() for m in masks] == [[n[p[i : i + 200]] > 1 for i in range(len(p) - 199)] for p in pieces]


CLASHING = "doc_id long, text string, k long, t1 long, k_ string, t1_ string, row string, marks int, marks_ int, all_gone boolean, gone_ boolean, sha string"


def test_columns_of_any_name_pass_through(spark):
    t = "".join(random.Random(6).choices("abcdef ", k=400))
    rest = (5, 6, "k", "t", "r", 1, 2, True, False, "s")
    rows = [(1, t, *rest), (2, t, *rest), (3, t[:260] + "!", *rest), (4, None, *rest), (5, "short", *rest)]
    df = spark.createDataFrame(rows, CLASHING)
    got = sd.without_repeats(df)
    assert got.columns == df.columns
    want = brute([x[1] for x in rows])
    assert sorted(map(tuple, got.collect())) == sorted((x[0], None if x[1] is None else w[4].decode(), *rest) for x, w in zip(rows, want))
    assert sd.repeat_report(df).count() == 5


def test_rows_without_id_are_told_apart_by_their_texts(spark):
    # a join on the missing id alone would pair each of these with each
    r = random.Random(7)
    core = "".join(r.choices("abcdef ", k=230))
    rows = [(None, "".join(r.choices("abcdef ", k=r.randrange(0, 60))) + (core if k % 2 else "") + str(k)) for k in range(120)]
    got = Counter(tuple(x) for x in sd.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((None, *w[:4]) for w in brute([t for _, t in rows]))
    scanned, copies, marks = sd._find(spark.createDataFrame(rows, "doc_id long, t string"))
    assert sd._keyed(spark.createDataFrame(rows, "doc_id long, t string")).join(marks, ["k", "t1"]).count() == 60
