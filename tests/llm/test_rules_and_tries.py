"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib
from itertools import pairwise

import pytest

from strandworks.llm import conversation_trie as ct
from strandworks.llm import quality_rules as qr
from strandworks.llm import spelling as sp

DOCS = "doc_id long, text string, lang string, n long, word string, key string, stratum string, k long"


def documents(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, 1, "w", "k", "s", 2) for i, t, lang in rows], DOCS)


# --- op11 -------------------------------------------------------------------------------------------------------------


def measured(text):
    """The base numbers, from their definition."""
    text = text or ""
    spans = [m.group() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    windows = collections.Counter(zip(spans, spans[1:], spans[2:], strict=False))
    again = {i + j for i in range(len(spans) - 2) if windows[tuple(spans[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(spans), sum(map(len, spans)), sum(c in "#*$%&|<>" for c in text), dup, len(again), len(lines)


def edge_texts():
    rng = random.Random(3)
    out = [None, "", " \n\t\x0b\x0c\r ", "a", "a a", "a a a", "a a a a", "b\xa0c b\xa0c b\xa0c", "é|ü <x>\n\né|ü <x>\n \né|ü <x>", "x\x1cy\x85z 日本 日本", "w " * 40_000, "long" * 30_000, "a b c d a b c e a b c"]
    return out + ["".join(rng.choice(["a", "b", "é", "#", "x|"]) + rng.choice([" ", "\n", "\t", " \n ", " "]) for _ in range(rng.randint(1, 80))) for _ in range(60)]


def test_counts_of_rules():
    for text in edge_texts():
        assert qr.counts(text) == measured(text), text and text[:60]


def exact_tail(k, n, rate):
    return 1.0 if k >= n else sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))


def cutoffs_by_hand(rows, labels):
    """Every test of every cutoff, with exact tails."""
    good = {}
    for i, y in labels:
        if i is not None and y is not None:
            good[i] = max(y, good.get(i, 0))
    used = []
    for i, t, lang in rows:
        n, chars, symbols, dup, again, lines = measured(t)
        if i in good and n >= 50 and 100 * again <= 50 * n:
            used.append((lang, hashlib.md5(str(i).encode()).hexdigest() >= "8", good[i], {"symbols": 1000 * symbols // chars, "lines": 1000 * dup // lines, "repeats": 1000 * again // n, "lengths": min(1000, 25 * chars // n)}))
    strata, out = {u[0] for u in used}, {}
    for s in strata:
        for rule in qr.RULES:
            best = None
            for cut in qr.LADDER:
                held = [u[3][rule] > cut for u in used if u[0] == s and u[1] and u[2] == 1]
                if exact_tail(sum(held), len(held), qr.RISK / 4) > qr.DELTA / (4 * len(strata)):
                    break
                gain = sum(1 if u[2] == 0 else -1 for u in used if u[0] == s and not u[1] and u[3][rule] > cut)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, cut, len(held), sum(held))
            if best:
                out[s, rule] = best[1:]
    return out


def ruled(seed=5, n=2600):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(50, 70))]
        if bad and rng.random() < 0.8:
            words = [w + "###" if rng.random() < 0.5 else w for w in words]
        elif rng.random() < 0.004:
            words[0] += "#" * 60  # a good document with many symbols, or a bad one
        rows.append((i, " ".join(words), None if i % 20 == 7 else "de" if i % 20 == 3 else "en"))
        labels.append((i, int(not bad)))
    return rows + [(None, "no id", "en"), (5, None, "en")], labels + [(None, 1), (3, None), (7, 0), (7, 1)]


def test_cutoffs_hold_their_bound(spark):
    rows, labels = ruled()
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    found = qr.cutoffs(qr.measured(documents(spark, rows), ["doc_id", "lang"]), table)
    got = {(r.stratum, r.rule): (r.cutoff, r.n, r.k) for r in found.collect()}
    assert got == cutoffs_by_hand(rows, labels)
    assert ("en", "symbols") in got and not any(s in (None, "de") for s, _ in got)  # too few labels to prove anything
    for _, n, k in got.values():
        assert exact_tail(k, n, qr.RISK / len(qr.RULES)) <= qr.DELTA / (3 * len(qr.RULES))
    assert exact_tail(0, 300, 0.01) == pytest.approx(0.99**300)


def test_rules_are_applied(spark):
    rows, labels = ruled()
    rows += [(0, rows[0][1], "en"), (10**6, "never seen " * 2, "xx")]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    cut = cutoffs_by_hand(rows, labels)
    got = sorted((tuple(r) for r in qr.apply_rules(documents(spark, rows), table).select("doc_id", *qr.COUNTS, "base_failed", "kept").collect()), key=repr)
    want = []
    for i, t, lang in rows:
        n, chars, symbols, dup, again, lines = m = measured(t)
        failed = n < 50 or 100 * again > 50 * n
        shares = {"symbols": (symbols, chars, 1000), "lines": (dup, lines, 1000), "repeats": (again, n, 1000), "lengths": (chars, n, 25)}
        fired = any(b and min(1000, f * a // b) > cut[lang, r][0] for r, (a, b, f) in shares.items() if (lang, r) in cut)
        want.append((i, *m, failed, not failed and not fired))
    assert got == sorted(want, key=repr)


def test_rules_without_rows(spark):
    none, labels = documents(spark, []), spark.createDataFrame([], "doc_id long, quality int")
    assert qr.apply_rules(none, labels).count() == 0
    some = documents(spark, [(1, "word " * 80, "en"), (2, " ".join(f"w{i}" for i in range(80)), None)])
    assert sorted((r.doc_id, r.kept) for r in qr.apply_rules(some, labels).collect()) == [(1, False), (2, True)]


# --- op12 -------------------------------------------------------------------------------------------------------------


def vocabulary_by_hand(rows, least=5):
    total = collections.Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_hand(v):
    near = {w: [u for u in v if one_edit(w, u)] for w in v}
    best = {w: min(near[w], key=lambda u: (-v[u], u), default=None) for w in v}
    form = {w: b if b and v[b] >= 5 * v[w] else None for w, b in best.items()}
    out = []
    for w, n in v.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), v[form[w]] if form[w] else None))
    return sorted(out)


def spelled(seed=11):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aabeéstnÿ") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    pool = []
    for w in words:
        weight = rng.choice([5, 30, 200])
        pool += [w] * weight
        for _ in range(4):
            i = rng.randrange(len(w))
            pool += [rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "ö" + w[i + 1 :]])] * rng.choice([1, 5, 6, 40])
    chain = ["gamble", "gambles", "gamblest", "gamblests"]  # forms of forms
    for w, n in zip(chain, (1000, 150, 28, 5), strict=True):
        pool += [w] * n
    pool += ["tieone", "tietwo"] * 60 + ["tieoneo", "tietwoo"] * 5 + ["tiewne"] * 60 + ["É" + "x" * 8, "é" + "x" * 8] * 7
    rng.shuffle(pool)
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in pool[i::60]) + rng.choice(["×", "!", ""]), "en") for i in range(60)]
    long = "long" * 4000
    return rows + [(100, None, "en"), (101, "", None), (None, "nobody " * 9, "en"), (102, f"{long} " * 6 + f"{long}x " * 6, "en"), (102, "repeat rows " * 3, "en"), (102, "repeat rows " * 3, "en")]


@pytest.mark.parametrize(("groups", "block"), [(12, 2000), (12, 3), (4, 2), (3, 1)])
def test_variants(spark, groups, block):
    rows = spelled()
    want = variants_by_hand(vocabulary_by_hand(rows))
    got = sorted((tuple(r) for r in sp.variants(documents(spark, rows), groups=groups, block=block).collect()), key=lambda r: r[0])
    assert got == want
    assert dict((w, r) for w, _, r, *_ in want)["gamblests"] == "gamble" and len(want) > 80


def test_no_words(spark):
    assert sp.variants(documents(spark, [])).count() == 0
    assert sp.variants(documents(spark, [(1, "few words", "en")])).count() == 0


def test_a_search_goes_one_way():
    rng = random.Random(2)
    for _ in range(2000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(3, 5)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(3, 5)))
        if a != b and len(a) <= len(b):
            assert sp.is_near(a, b) == one_edit(a, b)


# --- op13 -------------------------------------------------------------------------------------------------------------


def trie_by_hand(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - c % 20
        built[c] = v if base == c else own.get(base, [])[:h] + v[h:]
    nodes = collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * words
    ends = {k: ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)) for k, m in nodes.items()}
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in nodes.items()), key=repr)


def talks(seed=13):
    rng = random.Random(seed)
    says = ["hi", "", "how are you", "a b  c\n d", "é\xa0x y", "same"]
    rows = []
    for c in [*range(0, 90), 119, 121, 400, 407, 1999]:
        if c in (20, 60):
            continue  # a base that is absent
        n = rng.choice([1, 2, 3, 6]) if c % 20 else rng.choice([1, 2, 5])
        rows += [(c, t, rng.choice(["user", "bot"]) if c % 3 else "user", rng.choice(says[:2]) if c % 3 else "hi") for t in range(n)]
    rows += [(c, t, "user", f"step {t}") for c in (40, 80, 2000, 2040) for t in range(100, 130)]  # long common ways
    rows += [(3, None, None, None), (3, None, "bot", "late"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "bot", "tie"), (None, 0, "user", "nobody"), (8, 50, "user", "word " * 20_000), (9, 9, "userx", "y"), (29, 9, "user", "xy")]
    rng.shuffle(rows)
    return rows


TURNS = "conv_id long, turn long, role string, text string, depth long, at long, words long"


@pytest.mark.parametrize("seed", [13, 14])
def test_trie(spark, seed):
    rows = talks(seed)
    table = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], TURNS)
    got = sorted((tuple(r) for r in ct.prefix_trie(table).collect()), key=repr)
    assert got == trie_by_hand(rows) and max(r[1] for r in got) > 30


def test_one_conversation_over_all_parts(spark):
    rows = [(20, t, "user", f"turn {t}") for t in range(300)] + [(21, t, "user", f"turn {t}") for t in range(299)] + [(20 * i, 0, "user", "x") for i in range(2, 9)]
    got = sorted((tuple(r) for r in ct.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    assert got == trie_by_hand(rows)


def test_no_conversations(spark):
    assert ct.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert ct.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, 1, 1)], TURNS)).count() == 0


def test_products_are_a_monoid():
    rng = random.Random(1)
    parts = [ct.Print(rng.randrange(ct.PRIME), rng.randrange(1, 50)) for _ in range(30)]
    for (a, b), c in zip(pairwise(parts), parts[2:], strict=False):
        assert (a * b) * c == a * (b * c) and (a * b).after(a) == b and ct.Print(0, 0) * a == a == a * ct.Print(0, 0)


def test_equal_prints_of_different_turns_are_noticed(spark, monkeypatch):
    turns = spark.createDataFrame([(1, "user", "a"), (2, "user", "b")], "at long, role string, text string")
    every = spark.createDataFrame([(1, 5, 6, 0, 0, 1), (1, 5, 6, 0, 0, 2)], "depth long, x long, y long, px long, py long, at long")
    with pytest.raises(RuntimeError):
        ct.verify(every, turns)
