"""Both substring operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from talentlake.llm import substring_dedup, suffix_dedup, windows


def brute(rows, symbols, join):
    """(number of symbols, removed, runs, sha256 of the rest) of each row, in order."""
    first = {}
    order = lambda i: windows.LAST if i is None else i
    split = [(order(i), symbols(t or "")) for i, t in rows]
    for i, s in split:
        for k in range(len(s) - 49):
            first[s[k : k + 50]] = min(first.get(s[k : k + 50], i), i)
    out = []
    for i, s in split:
        gone = [False] * len(s)
        for k in range(len(s) - 49):
            if first[s[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        kept = join([x for x, g in zip(s, gone) if not g])
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(s), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def sample(seed=1):
    """Shared passages, copies, near copies, repeating text, edge lengths, nulls, repeated rows and ids."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line, base = text(80), text(52), text(150)
    rows = [(1, base), (2, base), (3, None), (4, ""), (4, ""), (5, "x" * 49), (6, "x" * 50), (7, "x" * 400), (8, "x" * 51), (None, base), (None, passage), (9, "\t \n")]
    rows += [(10, "a " * 300), (11, "a " * 49), (12, "a\n" * 50), (13, passage + "\n" + text(30)), (14, text(20) + " " + passage), (14, passage)]
    near = base.split()
    near[70] = "changed"
    rows += [(15, " ".join(near)), (16, "  ".join(base.split())), (20, base + " " + base)]
    rows += [(100 + i, text(r.randint(0, 40)) + " " + line + " " + text(r.randint(0, 40))) for i in range(40)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 1, 2) for i, t in rows], "doc_id long, text string, chunk string, bucket int, segment int, first long").repartition(3)


@pytest.mark.parametrize("hot", [1000, 3])
def test_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(windows, "LEAST_HOT", hot)
    rows = sample()
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    want = brute(rows, lambda t: t.encode(), bytes)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


@pytest.mark.parametrize("hot", [1000, 3])
def test_words(spark, monkeypatch, hot):
    monkeypatch.setattr(windows, "LEAST_HOT", hot)
    rows = sample(2)
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    want = brute(rows, lambda t: tuple(w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t)), b" ".join)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((str(i), w[0], w[1], w[3]) for (i, _), w in zip(rows, want))


def test_clean_keeps_rows_and_columns(spark):
    rows = sample(3)
    docs = frame(spark, rows)
    got = substring_dedup.clean(docs)
    assert got.columns == docs.columns
    want = brute(rows, lambda t: tuple(w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t)), b" ".join)
    kept = [(i, t, n) for (i, t), (n, gone, _, _) in zip(rows, want) if not gone or gone < n]
    found = got.collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _, _ in kept)
    untouched = {t for (_, t), (_, gone, _, _) in zip(rows, want) if not gone}
    assert untouched <= {r.text for r in found}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0 and substring_dedup.clean(none).count() == 0


def test_very_long_text(spark):
    r = random.Random(5)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60_000))
    got = {x.doc_id: x for x in substring_dedup.remove_repeats(spark.createDataFrame([(1, long), (2, "new " + long + " end")], "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed) == (0, 60_000)


def test_suffix_order_is_sorted():
    r = random.Random(8)
    for alphabet in (b"ab", b"\x00a", bytes(range(256))):
        strings = [bytes(r.choice(alphabet) for _ in range(r.randint(1, 30))) for _ in range(60)]
        symbols, common = suffix_dedup.suffix_order(suffix_dedup.Columns(strings), 12)
        shifted = [s[a:] + b"\0" * (-len(s[a:]) % 4) for s in strings for a in range(4)]
        # Suffixes of whole blocks; a shorter one stands before, and ties in the order of the strings.
        suffixes = sorted(([s[i : i + 4] for i in range(k, len(s), 4)], n) for n, s in enumerate(shifted) for k in range(0, len(s) + 1, 4))
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(b"".join(a), b"".join(b))) if x != y), min(len(b"".join(a)), len(b"".join(b))))
        assert len(symbols) == len(suffixes)
        assert common.tolist() == [0, *[min(12, shared(a[0], b[0])) for a, b in zip(suffixes, suffixes[1:])]]


def test_order_of_long_blocks_and_first_documents():
    r = random.Random(9)
    for alphabet in (b"ab", b"\x00a", bytes(range(256))):
        strings = [bytes(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(60)]
        strings += [s + t for s, t in zip(strings[:20], strings[20:40])]
        columns = suffix_dedup.Columns(strings, 8)
        symbols, common, order = suffix_dedup.transform(columns, 20)
        assert len(columns.symbols) == -(-max(map(len, strings)) // 8)
        assert order.tolist() == [i for i in np.argsort(symbols, kind="stable") if symbols[i]]
        shifted = [s[a:] + b"\0" * (-len(s[a:]) % 8) for s in strings for a in range(8)]
        suffixes = sorted(([s[i : i + 8] for i in range(k, len(s), 8)], n) for n, s in enumerate(shifted) for k in range(0, len(s) + 1, 8))
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common.tolist() == [0, *[min(20, shared(b"".join(a[0]), b"".join(b[0]))) for a, b in zip(suffixes, suffixes[1:])]]
        strings = list(dict.fromkeys(s for s in strings if len(s) >= 8))
        first = np.array([r.randrange(10) for _ in strings])
        least = {}
        for s, d in zip(strings, first.tolist()):
            for i in range(len(s) - 7):
                least[s[i : i + 8]] = min(d, least.get(s[i : i + 8], d))
        found = {}
        for s, a, b, d in zip(*(x.tolist() for x in suffix_dedup.first_documents(strings, first, 8))):
            found |= {(s, i): d for i in range(a, b + 1)}
        assert found == {(n, i): least[s[i : i + 8]] for n, s in enumerate(strings) for i in range(len(s) - 7)}


def test_broadcast_reference(spark):
    reference = [" ".join(f"w{i}" for i in range(k, k + 80)) for k in (0, 500, 1000)]
    docs = spark.createDataFrame([(1, "start " + reference[1] + " end"), (2, "none"), (3, None), (4, " ".join(f"w{i}" for i in range(10, 59)))], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in substring_dedup.remove_reference(docs, reference, shard_words=100).collect()}
    assert got[1] == "start end" and got[2] == "none" and got[3] == "" and len(got[4].split()) == 49


def test_runs_of_windows_share_keys():
    text = windows.Text(["a b " * 60, "x" * 60], windows.BYTES)
    at, count, key, doc = text.runs()
    assert count.sum() == 240 - 49 + 60 - 49 and set(doc.tolist()) == {0, 1} and count.max() <= windows.BYTES.span
    assert np.all(np.diff(at) > 0) and len(key) == len(at)
