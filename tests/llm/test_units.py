"""The operators' inner functions against brute force; no Spark needed."""

import hashlib
import random

import numpy as np
import pytest

from sparkward.llm import bpe, exact_dedup, license_scan, ngram_join, packing, quality_rules, secret_scan, suffix_dedup, toxicity

rng = random.Random(11)
WORDS = [w + x for w in ("the", "on", "re", "é", "ver", "ing") for x in ("", "st", "and", "ü", "7", "ing")]


def prose(n, lines=True):
    return "".join(rng.choice(WORDS) + (rng.choice("  \n,.") if lines else " ") for _ in range(n))


# --- quality


def count_by_hand(text):
    import re

    words = [m.group() for m in re.finditer("[^\x20\x09-\x0d]+", text)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


@pytest.mark.parametrize("text", ["", " \n\t", "a", "a b c d e", "a b c d e f a b c d e", "x " * 40, "a | b c \x0b#\na | b\n\n \na | b"] + [prose(n) for n in (3, 9, 60, 200)] + [(prose(12) + "\n") * 3 + prose(5)])
def test_counts(text):
    assert quality_rules.count_text(text)[:5] == count_by_hand(text)


# --- secrets


def test_secrets():
    text = 'é Api_Key : "abcdefghijkl" ſecret=abcdefghijklmnop password=short token=0123456789abcdef0123 AKIA12345678901234 AKIA123 DEADBEEFDEADBEEF'
    found = [(secret_scan.KINDS[k], text[a:b]) for a, k, b in secret_scan.find_secrets(text)]
    assert found == [("assign", 'Api_Key : "abcdefghijkl'), ("assign", "token=0123456789abcdef0123"), ("hex", "0123456789abcdef0123"), ("access", "AKIA12345678901234")]
    assert secret_scan.find_secrets("") == []
    added = [secret_scan.KINDS[k] for _, k, _ in secret_scan.find_secrets("ghp_" + "A" * 36 + " xoxb-1234567890-x eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh_-")]
    assert added == ["codehost", "chat", "jwt"]


def secrets_by_hand(text):
    """The base kinds, letter by letter."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    upper, digits = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), set("0123456789abcdef")
    found, n = [], len(text)

    def run(i, allowed):
        j = i
        while j < n and text[j] in allowed:
            j += 1
        return j

    def assigned(i):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, i):
                j = i + len(name)
                for quote in ((j + 1, j) if j < n and text[j] in "\"'" else (j,)):
                    k = run(quote, " ")
                    if k < n and text[k] in ":=":
                        k = run(k + 1, " ")
                        k += k < n and text[k] in "\"'"
                        end = run(k, value)
                        if end > k:
                            return k, end
        return None

    i = 0
    while i < n:
        if m := assigned(i):
            if m[1] - m[0] >= 12:
                found.append((i, 0, m[1]))
            i = m[1]
        else:
            i += 1
    i = 0
    while i < n:
        j = run(i + 4, upper) if text.startswith("AKIA", i) else i
        if j > i + 4:
            if j - i >= 18:
                found.append((i, 1, j))
            i = j
        else:
            i += 1
    i = 0
    while i < n:
        j = run(i, digits)
        if j - i >= 16:
            found.append((i, 2, j))
        i = max(j, i + 1)
    return sorted(found)


def test_secrets_by_hand():
    r = random.Random(4)
    parts = ["Password", "passwd", "SECRET", "token", "api_key", "ApiKey", "=", ":", " ", "  ", '"', "'", "abcdefabcdef", "0123456789abcdef", "A1b2+/=.-_", "AKIA", "ABCDEFGHIJ1234", "x", "é", "\n", "Z", "\u0130", "\u212a", "\u017f", "tokentoken="]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert [x for x in secret_scan.find_secrets(text) if x[1] < 3] == secrets_by_hand(text), text


def test_web_tokens_in_linear_time():
    import re
    import time

    plain = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    r = random.Random(6)
    for _ in range(4000):
        text = "".join(r.choice(["eyJ", "abcdefgh", ".", ".", "-_1", " ", "eyJabcdefghi"]) for _ in range(r.randint(0, 16)))
        assert secret_scan.find_jwts(text) == [m.span() for m in plain.finditer(text)], text
    start = time.perf_counter()
    for text in ("eyJ" * 300_000, "eyJabcdefgh." * 80_000, ".eyJabcdefgh" * 80_000):
        secret_scan.find_secrets(text)
    assert time.perf_counter() - start < 10


def test_masking_overlaps():
    text = "token=0123456789abcdef0123 end"
    spans = secret_scan._joined(secret_scan.find_secrets(text))
    assert secret_scan._masked(text, spans) == "[SECRET] end"


# --- licences


def test_license_base_places():
    r = license_scan.scan_text("Under, the MIT-License under the mit license x Apache License, Version 2.0 cc by nc under the mit licenses")
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (21, 4, 0, 14, "apache-2,cc-by-nc,mit")
    assert license_scan.scan_text("") == {"n_words": 0, "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}


def test_license_fuzzy():
    r = license_scan.scan_text("text befor. Released undr the MIT lisence. more")
    assert r["labels"] == "mit" and r["n_base"] == 0 and 0 < r["score"] < 1
    label, a, b, edits = r["spans"][0]
    assert "text befor. Released undr the MIT lisence. more"[a:b] == "Released undr the MIT lisence" and edits == 3
    assert license_scan.scan_text("released under the bsd license")["labels"] == ""
    gpl = "This work is licensed under the GNU General Public License, version 3."
    assert license_scan.scan_text(gpl)["labels"] == "gpl-3"
    assert license_scan.scan_text(gpl.replace("version 3", "version 2"))["labels"] == "gpl-2"
    assert license_scan.scan_text("Licensed under CC BY 4.0.")["labels"] == "cc-by"
    assert license_scan.scan_text(prose(500))["labels"] == ""


def test_license_places_before_a_better_one():
    mit = license_scan.Notice(*license_scan.NOTICES[0])
    assert mit.search("foo relased undr the mit license and released under the mit license bar") == [(4, 32, 2), (37, 67, 0)]
    texts = ["released under the mit license", "relased under the mit license", "relased undr the mit license", "released undr the mit lisence"]
    for k in range(4):
        chosen = texts[k:] + texts[:k]
        joined = " and ".join(chosen)
        assert [joined[a:b] for a, b, _ in mit.search(joined)] == chosen


def distances(part, text):
    """Edits between part and text[p:q], of every p and q."""
    out = []
    for p in range(len(text) + 1):
        row = list(range(len(part) + 1))
        ends = [row[-1]]
        for c in text[p:]:
            new = [row[0] + 1]
            for k, x in enumerate(part):
                new.append(min(row[k + 1] + 1, new[k] + 1, row[k] + (x != c)))
            row = new
            ends.append(row[-1])
        out.append(ends)
    return out


def places_by_hand(parts, text):
    """{(start, end): fewest edits} of all places where the parts stand, each within its edits."""
    best = {(p, p): 0 for p in range(len(text) + 1)}
    for part, k in parts:
        d, longer = distances(part, text), {}
        for (a, p), n in best.items():
            for q in range(p, len(text) + 1):
                if d[p][q - p] <= k:
                    longer[a, q] = min(longer.get((a, q), 99), n + d[p][q - p])
        best = longer
    return best


@pytest.mark.parametrize("which", range(len(license_scan.NOTICES)))
def test_license_search_against_edit_distances(which):
    notice = license_scan.Notice(*license_scan.NOTICES[which])
    parts = license_scan.NOTICES[which][1]
    r = random.Random(which)
    for _ in range(4):
        text = []
        for _ in range(r.randint(1, 3)):
            said = list(notice.text)
            for _ in range(r.randint(0, notice.edits + 2)):
                at = r.randrange(len(said))
                said[at : at + r.randint(0, 1)] = r.choice(["", "e", "x ", "t"])
            text += ["".join(said), r.choice([" ", " and ", ""])]
        text = "".join(text)[: 260 if len(notice.text) > 60 else 130]
        places, found = places_by_hand(parts, text), notice.search(text)
        assert all(places[a, b] == n for a, b, n in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        # nothing that stands is missed: what isn't reported overlaps what is
        assert all(any(a < y and b > x for x, y, _ in found) for a, b in places)


def test_license_places_in_linear_time():
    import time

    took = []
    for n in (2000, 16000):
        start = time.perf_counter()
        r = license_scan.scan_text("cc by nc " * n + "released under the mit licence " * (n // 20))
        took.append(time.perf_counter() - start)
        assert r["n_base"] == n and len(r["spans"]) == n // 20 and r["last_word"] == 3 * n - 3
    assert took[1] < 30 * took[0] + 1  # eight times the text


def test_license_base_by_hand():
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    r = random.Random(5)
    for _ in range(60):
        text = "".join(r.choice(["Under the MIT", " license", "-License ", "Apache", " license\nversion", " 2 ", "cc", " BY nc", "é", "_", ".", " x9 ", "İ "]) for _ in range(r.randint(0, 40)))
        words = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in "".join(c.lower() if c.isascii() else c for c in text)).split(" ")
        words = [w for w in words if w]
        at = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        got = license_scan.scan_text(text)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert got["base_labels"] == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(got["labels"].split(","))


# --- BPE


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return path, t


ODD = ["", " ", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|>\n\n x  ", "  \t\x1c\x1d y\x85z ​k 's't've DON'T don't", "a" * 3000, "日本語 😀😀 ñ́", "the" * 300, " " * 300 + "x", "１２３ ²³ Ⅷ ᠎ ﻿", "\x00\x01"]


def test_bpe_equals_the_library(tokenizer):
    path, t = tokenizer
    v = bpe.Vocabulary(path)
    texts = ODD + [prose(n) for n in (1, 50, 400)]
    lexicon = bpe.Transducer.build([w.encode() for x in texts[-2:-1] for w in set(v.split(x))], lambda w: v.merge(w.decode()))
    for own in (None, lexicon):
        ids, offsets = bpe.Encoder(v, own).encode(texts)
        data, ends = bpe.decode_bytes(v, ids, offsets)
        for k, x in enumerate(texts):
            expected = t.encode(x, add_special_tokens=False).ids
            assert ids[offsets[k] : offsets[k + 1]].tolist() == expected
            assert bytes(data[ends[k] : ends[k + 1]]).decode() == t.decode(expected, skip_special_tokens=False) == x


def test_merging_many_equals_one(tokenizer):
    v = bpe.Vocabulary(tokenizer[0])
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 60))) for _ in range(300)] + ["", "<|endoftext|>"]
    assert [x.tolist() for x in v.merge_many(words)] == [v.merge(w) for w in words]


def test_transducer(tmp_path):
    words = sorted({("".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))).encode() for _ in range(300)})
    t = bpe.Transducer.build(words, lambda w: list(w))
    (tmp_path / "t").write_bytes(t.dump())
    m = bpe.Transducer.mapped(str(tmp_path / "t"))
    index = m.lookup([*words, b"", b"abcabcabcabc", b"z"])
    assert index.tolist() == [*range(len(words)), -1, -1, -1]
    assert all(m.ids[m.offsets[i] : m.offsets[i + 1]].tolist() == list(words[i]) for i in range(len(words)))
    assert len(m.final) < sum(map(len, words))  # suffixes are shared


# --- suffix arrays


@pytest.mark.parametrize("make", [lambda: rng.randbytes(3000), lambda: bytes(rng.choice(b"ab") for _ in range(2500)), lambda: b"abcd" * 500, lambda: (x := rng.randbytes(400)) + b"q" + x + b"r" + x[50:350], lambda: b"a"])
def test_suffix_array_and_prefixes(make):
    data = np.frombuffer(make(), np.uint8)
    raw, n = data.tobytes(), len(data)
    sa, rank = suffix_dedup.suffix_array(data, 100)
    cut = [raw[i : i + 128] for i in range(n)]
    assert sorted(sa.tolist()) == list(range(n)) and all(cut[a].ljust(128, b"\0") <= cut[b].ljust(128, b"\0") for a, b in zip(sa, sa[1:]))
    prefixes = suffix_dedup.common_prefixes(data, sa, rank, 100)
    for i in range(n):
        if rank[i] == 0:
            assert prefixes[i] == 0
            continue
        j, k = int(sa[rank[i] - 1]), 0
        while k < 100 and i + k < n and j + k < n and raw[i + k] == raw[j + k]:
            k += 1
        assert prefixes[i] == k


@pytest.mark.parametrize("make", [lambda: rng.randbytes(3000), lambda: b"abcd" * 500, lambda: (x := rng.randbytes(400)) + b"q" + x + b"r" + x[50:350] + b"\0" * 150, lambda: bytes(rng.choice(b"ab") for _ in range(40)) * 30, lambda: b"\0" * 300])
def test_prefixes_where_suffixes_are_alike(make):
    data = np.frombuffer(make(), np.uint8)
    alike = np.zeros(len(data), bool)
    sa, rank = suffix_dedup.suffix_array(data, 100, alike)
    whole, some = suffix_dedup.common_prefixes(data, sa, rank, 100), suffix_dedup.common_prefixes(data, sa, rank, 100, alike)
    assert (some[alike] == whole[alike]).all() and (some[~alike] == 0).all() and (whole[~alike] < 100).all()


def test_owners_are_told_by_content():
    data = np.frombuffer(rng.randbytes(500) + b"xy" * 200, np.uint8)
    at, owner, h = suffix_dedup.owners(data, np.array([0, 450, 560]), np.array([450, 540, 900]))
    assert at.tolist() == [*range(0, 351), *range(560, 801)]
    for a, o in zip(at.tolist(), owner.tolist()):
        top = h[a : a + 85] >> np.uint64(24)
        assert o == a + int(np.argmin(top))


def test_shards_as_spark_has_them():
    # xxhash64(long) with seed 42, as pinned by Spark's own documentation of xxhash64
    import xxhash

    ids = np.array([0, 1, -1, 1 << 40, -(1 << 63), 123456789], np.int64)
    expected = [(xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), seed=42) + (1 << 63)) % (1 << 64) - (1 << 63) for i in ids.tolist()]
    assert suffix_dedup.shard_of(ids, 7).tolist() == [x % 7 for x in expected]


def test_settle_keeps_clashing_windows_apart():
    data = np.frombuffer(rng.randbytes(400), np.uint8)
    covered = []
    mark, place, at = suffix_dedup.settle(data, np.array([5, 5, 5], np.uint64), np.array([1, 2, 3]), np.array([0, 200, 0]), covered)
    assert sorted(place.tolist()) == [1, 2] and np.concatenate(covered).tolist() == [3]


# --- chunks


def test_chunks_cover_and_follow_content():
    a, b = rng.randbytes(30000), rng.randbytes(500)
    data = np.frombuffer(a + b + a, np.uint8)
    starts, ends = np.array([0, len(a)]), np.array([len(a), len(data)])
    cuts = exact_dedup.cut_points(data, starts, ends)
    first = exact_dedup.chunks_of(0, len(a), cuts[cuts < len(a)])
    second = exact_dedup.chunks_of(len(a), len(data), cuts[cuts > len(a)])
    assert b"".join(data[x:y].tobytes() for x, y in second) == b + a
    own = {hashlib.sha256(data[x:y].tobytes()).digest() for x, y in first}
    assert sum(hashlib.sha256(data[x:y].tobytes()).digest() in own for x, y in second) >= len(first) - 2
    assert exact_dedup.chunks_of(0, 200_000, np.zeros(0, int))[-1] == (196608, 200000) and exact_dedup.chunks_of(3, 3, np.zeros(0, int)) == []


# --- n-grams


def test_sets_and_sketches():
    s = ngram_join.Shingler()
    assert len(s.set_of([])) == 0 and len(s.set_of(["a"])) == 1 and len(s.set_of(list("abcabc"))) == 3
    words = [rng.choice(WORDS) + str(i % 50) for i in range(400)]
    other = words[:300] + [w + "x" for w in words[300:]]
    x, y = s.set_of(words), s.set_of(other)
    common = len(np.intersect1d(x, y))
    j = common / (len(x) + len(y) - common)
    a, b = (np.frombuffer(ngram_join.sketch(ngram_join.minhash(g)), np.uint64)[None] for g in (x, y))
    agree = int(ngram_join.agreement(a, b)[0, 0])
    assert abs((agree / 64 - 1 / 16) * 16 / 15 - j) < 0.25 and int(ngram_join.agreement(a, a)[0, 0]) == 64
    assert ngram_join.runs_for(0.995) == 4


# --- packing


def test_best_fit_against_a_plain_loop():
    n = 400
    sizes = np.array([rng.randint(0, 900) for _ in range(n)])
    sources, clusters = np.array([rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]), np.array([rng.randint(0, 150) for _ in range(n)])
    where, slot, offset, fill = packing.pack(sizes, sources, clusters, 1000, 2)
    bins, expected = [], np.zeros(n, int)
    for i in np.argsort(-sizes, kind="stable"):
        fits = [k for k, b in enumerate(bins) if sum(sizes[b]) + sizes[i] <= 1000 and sum(sizes[b]) < 1000 and list(sources[b]).count(sources[i]) < 2 and clusters[i] not in clusters[b]]
        k = min(fits, key=lambda k: (1000 - sum(sizes[bins[k]]), k)) if fits else len(bins)
        bins += [[]] * (k == len(bins))
        bins[k] = [*bins[k], i]
        expected[i] = k
    assert where.tolist() == expected.tolist()
    for b in range(len(fill)):
        own = np.flatnonzero(where == b)
        own = own[np.argsort(slot[own])]
        assert offset[own].tolist() == (np.cumsum(sizes[own]) - sizes[own]).tolist() and fill[b] == sizes[own].sum()


def test_empty_items_open_no_bins():
    sizes, same = np.array([600, 500, *[0] * 300]), np.zeros(302, int)
    where, slot, offset, fill = packing.pack(sizes, same, np.array([1, 2, *[3] * 300]), 1000, 2, empty_conflict=False)
    assert len(fill) == 2 and fill.tolist() == [600, 500] and where[:2].tolist() == [0, 1] and set(where[2:].tolist()) == {0}
    assert sorted(slot[where == 0].tolist()) == list(range(301)) and (offset[2:] == 600).all()
    assert len(packing.pack(sizes, same, np.array([1, 2, *[3] * 300]), 1000, 2)[3]) == 300


# --- trees


def test_trees_and_isotonic():
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.8)).astype(float)
    t = toxicity.Trees().fit(x[:1000], y[:1000])
    assert ((t.margin(x[1000:]) > 0) == (y[1000:] > 0.5)).mean() > 0.95
    m = r.normal(size=300)
    knots, p = toxicity.isotonic(m, (m + r.normal(size=300) > 0).astype(float))
    assert (np.diff(p) >= 0).all() and (np.diff(knots) >= 0).all()


def features_by_hand(text, lexicon):
    import math
    import re

    def weight(word):
        if word in lexicon.words:
            return lexicon.words[word], True
        stems = [s for s in lexicon.stems if word.startswith(s)]
        return (lexicon.stems[max(stems, key=len)], False) if stems else (0.0, False)

    raw, low = [], []
    for out, t in ((raw, text), (low, text.lower())):
        word = ""
        for c in t + " ":
            if c.isalnum() and not c.isdigit() and not c.isnumeric():
                word += c
            else:
                out += [word] * bool(word)
                word = ""
    n = len(low)
    hits = [(i, *weight(w)) for i, w in enumerate(low) if weight(w)[0] > 0]
    seconds = [i for i, w in enumerate(low) if w in toxicity._SECOND]
    near = sum(any(abs(i - j) <= 5 for j in seconds) for i, _, _ in hits)
    mixed = undone = 0
    for m in re.finditer(r"\S+", text):
        inner = [x for x in re.finditer(r"[0-9@$*!|+]+", m.group()) if x.start() > 0 and m.group()[x.start() - 1].isalpha() and x.end() < len(m.group()) and m.group()[x.end()].isalpha()]
        mixed += bool(inner)
        if inner:
            undone += weight("".join(c for c in m.group().lower().translate(toxicity._LEET) if c.isalpha()))[0] > 0
    letters = sum(map(len, raw))
    per = 100 / (n or 1)
    words, stems = sum(x for _, _, x in hits), sum(not x for _, _, x in hits)
    stretched = len(re.findall(r"([A-Za-z])\1\1+", text))
    return {
        "words": words, "stems": stems, "weighted": sum(w for _, w, _ in hits), "distinct": len({low[i] for i, _, _ in hits}), "density": (words + stems) * per, "second_person": len(seconds) * per, "near": near,
        "capitals": sum(c.isupper() for w in raw for c in w) / (letters or 1), "shouted": sum(len(w) > 2 and w.isupper() for w in raw) * per, "exclaims": sum(c in "!?" for c in text) * per,
        "punctuation": (len(text) - letters - sum(c in " \n" for c in text)) / (len(text) or 1), "mixed": mixed * per, "stretched": stretched * per, "undone": undone, "length": math.log1p(n), "word_length": letters / (n or 1),
    }


def test_features_by_hand():
    lexicon = toxicity.Lexicon({"moron": 3.0, "scum": 2.5}, {"lowe": 2.0, "lowei": 2.2})
    r = random.Random(3)
    for _ in range(500):
        text = " ".join(r.choice(["you", "Your", "moron", "MORON", "scum!", "loweixyz", "lowex", "m0ron", "sc@um", "ein", "d1ch", "yes?", "sooo", "AAAh", "é", "Éa", "42", "x|y", "\n"]) for _ in range(r.randint(0, 30)))
        got, expected = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon))), features_by_hand(text, lexicon)
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got), (text, got, expected)


def test_features_of_odd_texts():
    lexicon = toxicity.Lexicon({"moron": 3.0}, {"lowei": 2.0})
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, lexicon)))
    assert len(toxicity.features("", lexicon)) == len(toxicity.FEATURES)
    assert f("you MORON, loweixyz")["words"] == 1 and f("you MORON, loweixyz")["stems"] == 1 and f("you moron")["near"] == 1
    assert f("m0r0n")["undone"] == 1 and f("m.o.r.o.n")["undone"] == 1 and f("moooron")["stretched"] == 100
