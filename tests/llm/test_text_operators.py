"""Operators on texts against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from strandworks.llm import language_id, mixing, packing, pseudonyms, quality_knn, repeats, simhash_golay, suffix_dedup, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, label int, id long, kid long"


def table(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, None, 1, 2, 3, 4, 5) for i, t, lang, source in rows], SCHEMA)


def texts(seed=1, n=40):
    random.seed(seed)
    words = ["the", "Maison", "über", "<s>", "a", "of", "été", "x" * 30, "日本", "12", "don't", "<|endoftext|>", "▁"]
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, "   ", "en", "a"), (3, "\n\n a", "de", None), (4, "word " * 3000, "en", "b"), (4, "word " * 3000, "en", "b"), (None, "lost id", "en", "c")]
    for i in range(5, n):
        rows.append((i, "".join(random.choice(words) + random.choice([" ", "  ", "\n", ", ", "\t", "", " \n"]) for _ in range(random.randint(1, 60))), random.choice(["en", "de"]), random.choice(["a", "b", "c"])))
    return rows


def test_token_counts(spark):
    rows = texts()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t)) if t else 0) for i, t, *_ in rows)
    got = token_counts.token_counts(table(spark, rows), PIECES, limit=100).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.token_counts(table(spark, []), PIECES).count() == 0


def test_proof_holds():
    proof = token_counts.prove(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert proof.by_space and proof.by_line
    assert all(len(model.encode("a " + w)) == 2 for w in list(proof.after_space)[::50])


def test_packing(spark):
    rows = texts()
    tokenizer = Tokenizer.from_file(BYTES)
    ids = collections.defaultdict(list)
    for i, t, *_ in rows:
        ids[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    got = packing.pack(table(spark, rows).repartition(2), BYTES).collect()
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    for r in got:
        x = ids[r.doc_id][0]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= packing.TOKENS and len(v) <= packing.SEGMENTS
    assert packing.pack(table(spark, []), BYTES).count() == 0


@pytest.mark.parametrize("limits", [(64, 4, 64), (50, 100, 20), (64, 2, 10)])
def test_packing_limits(limits):
    random.seed(2)
    items = []
    for i in range(200):
        n = random.randint(1, 120)
        items.append(packing.Item(i, 0, bytes(4 * n), (random.randint(0, n), n)))
    done = packing.pack_items(items, limits)
    assert sum(s.tokens for s in done) == sum(i.tokens for i in items)
    assert sum(s.loss for s in done) == sum(i.loss for i in items)
    assert all(s.tokens <= limits[0] and len(s.pieces) <= limits[1] and s.loss <= limits[2] for s in done)


def test_packing_ids_are_the_library_s():
    ids, tokenizer = packing.Ids(BYTES), Tokenizer.from_file(BYTES)
    assert ids.merges is not None
    random.seed(11)
    every = "".join(chr(c) for c in [*range(0xD800), *range(0xE000, 0x2FA20, 7)])
    odd = [" " * 150_000, "a" * 20_000, "x\n \t" * 3000, " " * 90_000 + "x", "<|endoftext|> a <|endoftext|>", "it's we'LL 'tis'", every, "\x1c \x85 \u180e\u2028"]
    for t in [*odd, *(t for _, t, *_ in texts(seed=12) if t)]:
        assert ids.of(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_prompts_bear_no_loss(spark):
    rows = [(i, " word" * (20 + i % 50), " ask" * (i % 90)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt string")
    got = packing.pack(docs, BYTES, (128, 3, 60), prompt_col="prompt").collect()
    asked = {i: i % 90 for i, *_ in rows}
    used = collections.defaultdict(lambda: [0, 0, 0])
    for r in got:
        loss = max(0, min(r.start + r.length, r.doc_tokens - 1) - max(r.start, asked[r.doc_id]))
        for k, x in enumerate((r.length, 1, loss)):
            used[r.sequence_id][k] += x
    assert sum(r.length for r in got) == sum(20 + i % 50 + i % 90 + 1 for i, *_ in rows)
    assert all(x[0] <= 128 and x[1] <= 3 and x[2] <= 60 for x in used.values())
    assert all(any(x[k] == m for x in used.values()) for k, m in ((1, 3), (2, 60)))  # segments and loss both bind


def test_mixing(spark):
    rows = [*texts(), *[(1000 + i, "same size text", "en", "hot") for i in range(5000)]]
    got = mixing.mix(table(spark, rows)).collect()
    size = {None: 0}
    own, target, taken = collections.Counter(), {}, collections.Counter()
    source = {}
    for i, t, _, s in rows:
        size[i], source[i] = len(re.findall(mixing.WORD, t or "")), s
        own[s] += size[i]
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == own[s] and 0 <= r.taken <= 2 * r.size
        target[s] = r.target
        taken[s] += r.taken
    assert abs(sum(target.values()) - 1.5 * sum(own.values())) < 1e-6
    assert all(target[s] <= 2 * own[s] + 1e-9 for s in target)
    assert all(abs(taken[s] - target[s]) <= 3 for s in target if s != "b")
    assert abs(taken["b"] - target["b"]) <= 300  # two texts of 3000 words leave no nearer sum once each text is taken
    again = mixing.mix(table(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(table(spark, [])).count() == 0


def test_knapsack_is_exact():
    random.seed(4)
    for _ in range(50):
        lengths = sorted(random.sample(range(1, 30), 4))
        counts = [random.randint(0, 4) for _ in lengths]
        budget = random.randint(1, 120)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        taken = mixing.knapsack(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert sum(t * n for t, n in zip(taken, lengths, strict=True)) == min(sums, key=lambda s: (abs(s - budget), s))


def test_targets_share_the_excess():
    found = mixing.targets([("b", 10), (None, 1000), ("a", 100)])
    assert [x.name for x in found] == ["a", "b", None]
    assert found[0].target == 200 and found[1].target == 20 and abs(sum(x.target for x in found) - 1.5 * 1110) < 1e-9


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(prints, bits):
    nodes = sorted(set(prints.values()))
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(nodes):
        for y in nodes[:i]:
            if (x ^ y).bit_count() <= bits:
                root[find(x)] = find(y)
    least = {}
    for k, x in prints.items():
        least[find(x)] = min(k, least.get(find(x), k))
    return {k: least[find(x)] for k, x in prints.items()}


def test_simhash(spark):
    rows = [r for r in texts(3, 60) if r[0] is not None]
    base = "one two three four five six seven eight nine ten " * 40
    rows += [(200 + i, base + f" tail{i} more", "en", "a") for i in range(60)]
    prints = {i: simhash(t) for i, t, *_ in rows}
    want = components(prints, 3)
    got = simhash_golay.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", want[i]) for i in prints}
    assert simhash_golay.near_duplicates(table(spark, [])).count() == 0


def test_links_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(simhash_golay, "BLOCK", 16)
    random.seed(6)
    centre = random.getrandbits(64)
    prints = {i: centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 3))) for i in range(150)}
    prints |= {1000 + i: random.getrandbits(64) for i in range(50)}
    want = components(prints, 3)
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in set(prints.values())], "fp long")
    pairs = {(r.a, r.b) for r in simhash_golay.links(nodes).collect()}
    found = components_of(pairs, {int(np.uint64(x).view(np.int64)) for x in prints.values()})
    assert len(set(found.values())) == len(set(want.values()))


def components_of(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return {x: find(x) for x in nodes}


def test_golay_keys_are_complete():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    assert (np.bitwise_count(simhash_golay.decode(words) ^ simhash_golay.decode(words)) == 0).all()
    for _ in range(3):
        other = words ^ (1 << rng.integers(0, 23, 300)) ^ (1 << rng.integers(0, 23, 300))
        a, b = simhash_golay.fuzzy_keys(words), simhash_golay.fuzzy_keys(other)
        assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_suffix_dedup(spark, monkeypatch):
    random.seed(3)
    base = "".join(random.choice("abcde fg") for _ in range(1500))
    docs = [(0, None), (1, ""), (2, "x" * 900), (3, "ab" * 300), (None, base[:700])]
    for i in range(4, 30):
        t = ""
        while random.random() < 0.75:
            j = random.randrange(1000)
            t += base[j : j + random.randint(100, 700)] if random.random() < 0.6 else "".join(random.choice("abcdé fg") for _ in range(random.randint(1, 300)))
        docs.append((i, t))
    docs += docs[10:12]
    count = collections.Counter()
    for _, t in docs:
        raw = (t or "").encode()
        count.update(raw[i : i + 400] for i in range(len(raw) - 399))
    want = []
    for k, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 399):
            if count[raw[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        want.append((k, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    rows = [(i, t, None, None) for i, t in docs]
    for many in (4000, 2):
        monkeypatch.setattr(suffix_dedup, "MANY", many)
        got = [tuple(r) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    named = spark.createDataFrame([(f"d{i}", t) for i, t in docs], "doc_id string, text string")
    kept = suffix_dedup.remove_repeats(named, keep_text=True).collect()
    assert sorted((r.doc_id, *r[1:5]) for r in kept) == sorted((f"d{x[0]}", *x[1:]) for x in want)
    assert all(len(r.text.encode()) <= r.n_bytes - r.n_removed for r in kept)
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_suffix_dedup_of_many_equal_rows(spark):
    random.seed(6)
    long = "".join(random.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, long, None, None)] * 3000 + [(2, "x" + long[100:900] + "y", None, None), (3, long[:399], None, None)]
    got = collections.Counter((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect())
    assert got == {(1, 3000, 1): 3000, (2, 800, 1): 1, (3, 0, 0): 1}


def test_merged_repeats_despite_equal_hashes(monkeypatch):
    full = repeats.rolling
    monkeypatch.setattr(repeats, "rolling", lambda data, sizes: [x % np.uint64(5) for x in full(data, sizes)])
    test_merged_repeats()


def test_merged_repeats():
    random.seed(5)
    for trial in range(120):
        letters = b"ab" if trial % 3 == 0 else b"abcdefgh"
        base = bytes(random.choice(letters) for _ in range(200))
        runs = []
        for _ in range(random.randint(1, 12)):
            r = b""
            while random.random() < 0.8:
                i = random.randrange(180)
                r += base[i : i + random.randint(5, 80)] if random.random() < 0.6 else bytes(random.choice(letters) for _ in range(random.randint(1, 40)))
            runs.append(r)
        count = collections.Counter(r[i : i + 24] for r in runs for i in range(len(r) - 23))
        want, got = {}, {}
        for k, r in enumerate(runs):
            gone = {j for i in range(len(r) - 23) if count[r[i : i + 24]] > 1 for j in range(i, i + 24)}
            if gone:
                want[k] = gone
        for i, starts, ends in repeats.merged_repeats(runs, 24, 4, shard_bytes=random.choice([1, 40, 1000])):
            got[i] = {j for a, b in zip(starts, ends, strict=True) for j in range(a, b)}
        assert want == got


def test_pseudonyms(spark):
    f = pseudonyms.Feistel(b"key")
    for n in (2, 3, 10, 97, 256, 1000):
        assert sorted(f.permute("t", x, n) for x in range(n)) == list(range(n))
        assert all(f.permute("t", f.permute("t", x, n), n, back=True) == x for x in range(n))
    text = "card 4111 1111 1111 1111, 4111111111111112; +1 (504) 555-2652 on 2024-02-29 or 30/12/1999, 12/30/1999 not 2023-02-30; ip 10.0.0.1 999.1.1.1 mail ann.lee@mail.example.com ssn 123-45-6789 token 9a8b99b6f89edc9746a2ef7e89e21f68bcb4543d DE89370400440532013000 Licence 4.0"
    new, n = pseudonyms.replace(text, f)
    assert n == 10
    for kept in ("4111111111111112", "2023-02-30", "999.1.1.1", "Licence 4.0", "@mail.example.com"):
        assert kept in new
    for gone in ("4111 1111 1111 1111", "555-2652", "2024-02-29", "30/12/1999", "12/30/1999", "10.0.0.1", "ann.lee", "123-45-6789", "9a8b99b6", "DE89370400440532013000"):
        assert gone not in new
    assert len(new) == len(text) or abs(len(new) - len(text)) < 12  # addresses may change length
    assert pseudonyms.replace(new, f, back=True)[0] == text
    digits = "".join(re.findall(r"\d", re.search(r"card ([\d ]+),", new)[1]))
    assert pseudonyms.luhn_digit(digits[:-1]) == digits[-1]
    rows = [(1, text, "en", "a"), (2, text, "en", "a"), (2, text, "en", "a"), (3, None, None, None), (4, "", None, None), (None, "clean words", None, None)]
    got = pseudonyms.pseudonymise(table(spark, rows), b"key").collect()
    assert {r.text for r in got} == {new, None, "", "clean words"}
    assert sorted(r.n_replaced for r in got) == [0, 0, 0, 10, 10, 10]
    assert pseudonyms.pseudonymise(table(spark, []), b"key").count() == 0


def test_month_first_dates_stay_apart():
    f = pseudonyms.Feistel(b"k")
    seen = {}
    for day in range(13, 32):
        for month in range(1, 13):
            t = f"{month:02d}/{day:02d}/2001"
            new = pseudonyms._date(f, t, False)
            if new:
                assert pseudonyms._date(f, new, True) == t
                seen[new] = t
    assert len(seen) == len(set(seen.values()))


def test_language(spark):
    random.seed(8)
    vocab = {"en": ["the", "house", "with", "water", "stone"], "fr": ["le", "maison", "avec", "pierre", "été"], "de": ["das", "haus", "mit", "wasser", "über"]}
    rows = [(i, " ".join(random.choices(vocab[lang], k=12)), lang, "a") for i, lang in enumerate(random.choices(list(vocab), k=200))]
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (902, "123 !?", "en", "a"), (903, "housing waters", None, "a"), (904, "maisons", None, "b"), (904, "maisons", None, "b"), (None, "haus", None, None)]
    docs = table(spark, rows)
    from strandworks.llm.common import is_train

    model = language_id.fit(docs, is_train("doc_id", 3, 1))
    got = {}
    for r in language_id.identify(docs, model).collect():
        got[r.doc_id] = (r.lang_pred, r.score)
        assert 0 <= r.score <= 1
    assert all(got[i][0] == lang for i, _, lang, _ in rows[:200])
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert got[903][0] == "en" and got[904][0] == "fr"
    empty = table(spark, [])
    none = language_id.fit(empty, is_train("doc_id", 3, 1))
    assert [r.lang_pred for r in language_id.identify(docs.limit(1), none).collect()] == ["und"]
    assert language_id.identify(empty, model).count() == 0


def test_quality(spark):
    random.seed(9)
    good = lambda: " ".join(random.choices(["water", "stone", "house", "tree", "river", "cloud"], k=30)) + "."
    bad = [lambda: " | ".join(random.choices(["buy", "now", "cheap"], k=30)), lambda: "word " * 40, lambda: " ".join(w + "!!" for w in random.choices(["BUY", "NOW"], k=30))]
    rows = [(i, good() if i % 3 else random.choice(bad)(), None, "a") for i in range(300)]
    rows += [(900, None, None, None), (901, "", None, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    from strandworks.llm.common import is_train

    voters = quality_knn.fit(docs, labels, is_train("doc_id", 4, 2))
    got = {r.doc_id: r for r in quality_knn.vote(docs, voters).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == int(i % 3 > 0) for i in held) / len(held) > 0.95
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1
    none = quality_knn.fit(docs, labels.limit(0), is_train("doc_id", 4, 2))
    assert all(0 <= r.score <= 1 for r in quality_knn.vote(docs, none).collect())
    assert quality_knn.vote(table(spark, []), voters).count() == 0
