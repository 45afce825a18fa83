"""Each operator against a plain version of itself, and its defined cases."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import chat, decontam, htmltext, langid, linedup, packing, pii, simhash, similar, topk, toxicity
from loomgraph.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")
#: Further columns whose names the operators use themselves.
CLASHING = "score double, fp string, component_id string, rank int, u int, d int, w string, n int, ln int, length int, contamination int, language int, pii int, tokens int"


def docs(make, texts, start=0):
    return make(DOCS, [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts, start)])


def clash(df):
    for c in CLASHING.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit("1").cast(kind))
    return df


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sentence(rng, n, words=("alpha", "Beta", "gamma,", "delta", "épsilon", "zeta.", "eta")):
    return " ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(n))


# --- components ---------------------------------------------------------------------------------------------------


def test_components_of_chains_stars_and_loops(make):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (None, 3), (300, 301), (301, 300), (300, 301)]
    got = {r["node"]: r["label"] for r in connected_components(make("a long, b long", edges)).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {300: 300, 301: 300}
    assert connected_components(make("a long, b long", [])).count() == 0


def test_components_of_a_chain_whose_smallest_node_is_last(make):
    chain = [*range(1, 200), 0]
    got = connected_components(make("a long, b long", list(zip(chain, chain[1:]))))
    assert {r["node"]: r["label"] for r in got.collect()} == dict.fromkeys(chain, 0)


# --- language -----------------------------------------------------------------------------------------------------


def test_language(make):
    rng = random.Random(1)
    say = {"aa": "kala mano rito sula tamo".split(), "bb": "strumpf krach wolf zwerg holz".split(), "cc": "qui les dans pour avec".split()}
    rows = []
    for k in range(240):
        lang = rng.choice(list(say))
        rows.append((k, " ".join("".join(rng.choices(say[lang], k=2)) for _ in range(rng.randint(4, 80))).upper() + "!! 12", lang, "s", 0))
    rows += [(900, None, "aa", "s", 0), (901, "", "aa", "s", 0), (902, "12 !? 3", "aa", "s", 0), (903, "kala mano", None, "s", 0), (904, "kalamano ritosula " * 4000, "aa", "s", 0), (None, "kala", "bb", "s", 0)]
    df = clash(make(DOCS, rows))
    contents = langid.learn(df, fold=2, docs_per_lang=20)
    assert set(contents) == set(say)
    got = {r["doc_id"]: r["language"] for r in langid.identify(df, contents).collect()}
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[r[0]]["best"] == r[2] for r in held) >= 0.97 * len(held)
    assert all(got[k]["best"] == "und" and got[k]["score"] == 0 for k in (900, 901, 902))
    assert got[904]["best"] == "aa"
    assert all(0 <= x["score"] <= 1 for x in got.values())
    empty = make(DOCS, [])
    assert langid.learn(empty) == {}
    assert langid.identify(df, {}).select("language.best").distinct().collect()[0][0] == "und"
    assert langid.identify(empty, contents).count() == 0


def test_language_letters_and_sample(make):
    assert [langid.letters(t) for t in ("½ ² ①", "5²", "Ⅷ", "", None, "Ab½c 1é_ß")] == [b"", b"", b"", b"", b"", "ab c é ß".encode()]
    # One id with as many rows as all others, and a language of few words: neither changes what the others learn.
    rng = random.Random(3)
    rows = [(k, sentence(rng, 60), "aa" if k % 2 else "bb", "s", 0) for k in range(400)]
    more = rows + [(7, "the same " * 20, "aa", "s", 0)] * 400 + [(5000 + k, "rara lingua verba", "zz", "s", 0) for k in range(400)]
    few, many = (langid.learn(make(DOCS, r), docs_per_lang=100, chars_per_doc=2000, dict_bytes=16_384, even_from=8192) for r in (rows, more))
    assert set(many) == {"aa", "bb", "zz"} and many["bb"] == few["bb"] and len(many["aa"]) == len(many["bb"]) > 8192
    assert many["aa"].count(b"the same the same") <= 12
    assert len(many["zz"]) < 8192


def test_language_letters_are_category_l_at_the_cost_of_one_pass():
    every = "".join(map(chr, range(0x110000)))
    rng = random.Random(11)
    odd = ["".join(rng.choices("aÉß日𐐀 5½Ⅷ𐄇_-²\n\ud800K", k=rng.randint(1, 12))) for _ in range(3000)]
    for t in (every, every[:128], every[:0x10000], *odd):
        plain = "".join(c if c.isalpha() else " " for c in t.lower())
        assert langid.letters(t) == " ".join(x for x in plain.split(" ") if x).encode("utf-8", "surrogatepass")

    def seconds(f, t):
        best = 9.0
        for _ in range(3):
            start = time.process_time()
            f(t)
            best = min(best, time.process_time() - start)
        return best

    between = re.compile(r"[\W\d_]+")
    for word in ("language ", "größer "):
        assert seconds(langid.letters, word * 20_000) < 5 * seconds(lambda t: between.sub(" ", t), word * 20_000)


# --- line dedup ---------------------------------------------------------------------------------------------------


def removed_lines(texts, min_words):
    """By definition: every run of lines with enough words of which an equal run starts earlier, in document order."""
    gone = defaultdict(set)
    lines = {d: t.split("\n") for d, t in texts if t is not None}
    count = lambda line: line.strip(" ").count(" ") + 1 if line.strip(" ") else 0
    seen = set()
    for d in sorted(lines):
        own = lines[d]
        for a in range(len(own)):
            words = 0
            for b in range(a, len(own)):
                words += count(own[b])
                run = tuple(own[a : b + 1])
                if words >= min_words and run in seen:
                    gone[d].update(range(a, b + 1))
                seen.add(run)
    return {d: sorted(gone[d]) for d in lines}


def run_linedup(df, min_words):
    return {r["doc_id"]: (r["removed"], r["text"]) for r in linedup.remove_repeated_runs(df, min_words, removed="removed").collect()}


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_by_definition(make, seed):
    rng = random.Random(seed)
    pool = [sentence(rng, n) for n in (1, 2, 3, 4, 6, 9)] + ["", " ", "x y z"]
    texts = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.8 else sentence(rng, 3) for _ in range(rng.randint(1, 14)))) for k in range(30)]
    texts += [(50, texts[3][1]), (51, texts[3][1]), (52, "a b c d\n" * 9)]
    df = make(DOCS, [(k, t, None, None, None) for k, t in texts])
    want = removed_lines(texts, 8)
    got = run_linedup(df, 8)
    assert {k: v[0] for k, v in got.items()} == want
    for k, t in texts:
        assert got[k][1] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[k])


def test_line_dedup_cases(make):
    long = sentence(random.Random(0), 60)
    rows = [(1, None), (2, ""), (3, long), (4, f"keep me\n{long}\nand me"), (5, "keep me"), (6, long), (6, long), (None, long), (7, f"{long} "), (8, "\n".join(f"line {k}" for k in range(3000)))]
    df = clash(make(DOCS, [(k, t, "en", None, 1) for k, t in rows]))
    out = linedup.remove_repeated_runs(df, 50)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = [(1, None), (2, ""), (3, ""), (4, "keep me\nand me"), (5, "keep me"), (6, ""), (6, ""), (None, long), (7, f"{long} "), (8, rows[-1][1])]
    assert got == sorted(want, key=str)
    assert linedup.remove_repeated_runs(make(DOCS, []), 50).count() == 0


# --- PII ----------------------------------------------------------------------------------------------------------

PII_TEXT = ('Call +1 (651) 555-8500 or (212) 555-1234, card 4111 1111 1111 1111, 4111111111111111, IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789, '
            'host 192.168.10.1, born 1987-02-28, 28.02.1987, 02/28/1987 or 31/12/1999, mail Ann.b+c99@mail9.example.com, token = "f91f2b873bc89b9c5b8b3a486adf32c8523be758".')


def test_pii_round_trip_formats_and_links():
    key = hashlib.sha256(b"k").digest()
    new, spans = pii.pseudonymise(PII_TEXT, key)
    kinds = [k for _, _, k, _ in spans]
    assert kinds == ["phone", "phone", "card", "card", "iban", "ssn", "ipv4", "date", "date", "date", "date_dmy", "email", "secret"]
    assert re.sub(r"[0-9]", "9", new[:22]) == re.sub(r"[0-9]", "9", PII_TEXT[:22])
    assert pii.restore(new, spans, b"k") == PII_TEXT
    assert pii.pseudonymise(PII_TEXT, b"other" * 8)[0] != new
    # What the pseudonyms are, in the output.
    found, moved = defaultdict(list), 0
    for start, end, kind, length in spans:
        found[kind].append(new[start + moved : start + moved + length])
        moved += length - (end - start)
    cards = [re.sub(r"\D", "", c) for c in found["card"]]
    assert cards[0] == cards[1] and pii.luhn_ok(cards[0]) and cards[0] != "4" + "1" * 15


def test_pii_one_pseudonym_a_value_whatever_its_notation():
    key = hashlib.sha256(b"k").digest()
    to = lambda t: pii.pseudonymise(t, key)[0]
    digits = lambda t: re.sub(r"\D", "", t)
    assert len({digits(to(t)) for t in ("+15551234567", "+1 555 123 4567", "+1 (555) 123-4567", "+1.555.123.4567")}) == 1
    assert len({digits(to(t)) for t in ("+493012345678", "+49 30 12345678", "+49-30-1234-5678")} - {digits("+493012345678")}) == 1
    assert to("+3545551234")[:4] == "+354" and to("+15551234567")[:2] == "+1"
    for day in ("1987-12-25", "2024-02-13", "1999-10-31"):
        y, m, d = day.split("-")
        want = to(day).split("-")
        assert to(f"{d}.{m}.{y}").split(".") == want[::-1]
        assert to(f"{d}/{m}/{y}").split("/") == want[::-1]
        assert to(f"{m}/{d}/{y}").split("/") == [want[1], want[2], want[0]]


def test_pii_adjacent_values_come_back():
    rng = random.Random(17)
    key = hashlib.sha256(b"k").digest()
    pieces = ["4111111111111111", "4111 1111 1111 1111", "+1 555 123 4567", "+442079460958", "(555) 123-4567", "078-05-1120", "10.0.0.1", "255.255.255.255", "2020-12-25", "25/12/2020", "03/04/1999",
              "28.02.1987", "1234567890123456", "0000000000000000", "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "ann.b+c99@mail.example.com", '"f91f2b873bc89b9c5b8b3a486adf32c8523be758"',
              '"F91F2B873BC89B9C5B8B3A486ADF32C8523BE758"', "x", "12", "7", "+", "é", "1234567890123"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", "-", ".", "/", ", "]) for _ in range(rng.randint(1, 7)))
        new, spans = pii.pseudonymise(text, key)
        assert pii.restore(new, spans, b"k") == text


@pytest.mark.parametrize("card", ["4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1111", "4012888888881881"])
@pytest.mark.parametrize("after", [" 12/25", " 3", " 123", "-12", " 1", " 7"])
def test_pii_card_before_further_digits(card, after):
    key = hashlib.sha256(b"k").digest()
    new, spans = pii.pseudonymise(f"no {card}{after}.", key)
    assert spans[0][::2] == (3, "card") and card not in new
    assert pii.restore(new, spans, b"k") == f"no {card}{after}."
    if " " not in card and after[0] == " ":  # the same pseudonym as elsewhere
        assert new == f"no {pii.pseudonymise(card, key)[0]}{after}."


def test_pii_cards_with_any_digits_after_come_back():
    rng = random.Random(3)
    key = hashlib.sha256(b"k").digest()
    for _ in range(300):
        d = f"4{rng.randrange(10**14):014d}"
        d += str(-pii._luhn(d + "0") % 10)
        text = " ".join(d[k : k + 4] for k in range(0, 16, 4)) + f" {rng.randrange(1000):03d}"
        new, spans = pii.pseudonymise(text, key)
        assert spans and pii.restore(new, spans, b"k") == text


@pytest.mark.parametrize("text", ["1999-02-30", "300.1.1.1", "000-12-3456", "1.2.3", "12345", "DE00 3704 0044 0532 0130 00", "a@b", "x" * 5000 + "@", "+" * 300])
def test_pii_leaves_what_is_not_valid(text):
    assert pii.pseudonymise(text, b"k" * 32) == (text, [])


@settings(max_examples=80, deadline=None)
@given(st.integers(2, 10**18), st.integers(0, 10**18), st.binary(min_size=1, max_size=8))
def test_feistel_is_a_permutation(size, value, key):
    value %= size
    there = pii.feistel(value, size, key, "t")
    assert 0 <= there < size
    assert pii.feistel(there, size, key, "t", back=True) == value


def test_feistel_hits_everything_once():
    assert sorted(pii.feistel(k, 997, b"k", "t") for k in range(997)) == list(range(997))


def test_pii_documents(make):
    df = clash(docs(make, [PII_TEXT, None, "", "nothing here", PII_TEXT, "4111111111111111 " * 3000]))
    out = {r["doc_id"]: r for r in pii.pseudonymise_documents(df, b"k").collect()}
    assert out[0]["text"] == out[4]["text"] != PII_TEXT
    assert (out[1]["text"], out[2]["text"], out[3]["text"]) == (None, "", "nothing here")
    assert len(out[5]["pii"]) == 3000 and len(set(out[5]["text"].split())) == 1
    assert "4111111111111111" not in out[5]["text"]
    assert pii.pseudonymise_documents(make(DOCS, []), b"k").count() == 0


# --- top-k --------------------------------------------------------------------------------------------------------


def topk_plain(rows, factor, k):
    keep = [(i, n, np.floor(factor * np.array(v, np.float64)).astype(np.int64)) for n, (i, v) in enumerate(rows)
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, n, v in keep:
        if i % 50 == 0:
            s = sorted((-int(v @ u), j) for j, m, u in keep if m != n and len(u) == len(v))[:k]
            out += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dims", "shard"), [(700, 16, 64), (700, 16, 8192), (3, 4, 8192), (300, 2, 50)])
def test_topk_is_exact(make, n, dims, shard):
    rng = np.random.default_rng(n + dims)
    rows = [(k, rng.normal(0, 0.3, dims).round(2).astype(np.float32).tolist()) for k in range(n)]
    rows += [(1000, rows[0][1]), (1000, rows[0][1]), (50, rows[0][1]), (2000, None), (2001, []), (2002, [None] * dims), (2050, [float("nan")] * dims), (2100, [float("inf")] * dims), (None, rows[0][1]), (2150, [0.0] * dims), (2200, [1.0])]
    df = clash(make("vec_id long, embedding array<float>, label int", [(i, v, 0) for i, v in rows]))
    vectors = topk.scaled(df, 256)
    got = topk.search(topk.build_index(vectors, shard_rows=shard), vectors.where("vec_id % 50 = 0"), 5, step=4, share=0.02)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == topk_plain(rows, 256, 5)


def test_topk_of_large_components(make):
    rows = [(50, [1.0, 0.0]), (1, [5000.0, 0.0]), (2, [6000.0, 0.0]), (3, [7000.0, -1e9]), (100, [3e9, 1.0]), (4, [0.0, 0.0])]
    vectors = topk.scaled(make("vec_id long, embedding array<double>", rows), 256)
    got = topk.search(topk.build_index(vectors), vectors.where("vec_id % 50 = 0"), 3)
    assert sorted(map(tuple, got.collect())) == topk_plain(rows, 256, 3)
    far = topk.scaled(make("vec_id long, embedding array<double>", [(0, [2.0**40]), (1, [2.0**40])]), 256)
    with pytest.raises(Exception, match="64 bits"):
        topk.search(topk.build_index(far), far, 1).collect()
    with pytest.raises(Exception, match="64 bits"):
        topk.scaled(make("vec_id long, embedding array<double>", [(0, [1e300])]), 256)


@pytest.mark.parametrize("size", [1, 10**3, 10**7, 10**11])
def test_topk_bounds_hold_after_every_segment(size):
    rng = np.random.default_rng(size % 97)
    m = (rng.normal(0, 1, (300, 12)) * size).astype(np.int64)
    m[5:9] = m[4]
    shard = topk._Shard(next(pd.DataFrame([topk._shard(list(range(300)), list(range(300)), m)], columns=[c.split()[0] for c in topk.INDEX.split(", ")]).itertuples()))
    whole = m.astype(object) @ m[:20].astype(object).T
    for share in (0.0, 0.02, 0.5):
        found, read = shard.possible(m[:20], np.arange(20), 5, np.full(20, -np.inf), share)
        assert 1 <= read <= len(shard.segments)
        for j in range(20):
            order = sorted((-whole[i, j], i) for i in range(300) if i != j)[:5]
            assert {i for _, i in order} <= set(np.flatnonzero(found[:, j])) and j not in np.flatnonzero(found[:, j])
            assert shard.scores(np.arange(300), m[j]) == whole[:, j].tolist()


def test_topk_blocks_of_queries_and_nothing(make):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(0, 1, 8).tolist()) for k in range(400)]
    vectors = topk.scaled(make("vec_id long, embedding array<double>", rows), 256)
    got = topk.search(topk.build_index(vectors), vectors.where("vec_id % 50 = 0"), 5, block=3)
    assert sorted(map(tuple, got.collect())) == topk_plain(rows, 256, 5)
    none = topk.scaled(make("vec_id long, embedding array<double>", []), 256)
    assert topk.search(topk.build_index(none), none, 5).count() == 0


# --- SimHash ------------------------------------------------------------------------------------------------------


def fingerprint_plain(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups_plain(prints, k):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= k:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\n\x0b\x1c\xa0é字😀.", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fingerprint_plain(text)


def test_near_duplicates(make):
    rng = random.Random(3)
    texts = [sentence(rng, n) for n in (1, 2, 3, 30, 200, 900)]
    texts += [texts[5].replace(" ", "\n", 3), texts[5] + " end", texts[4].upper(), "", None, "  ", "É É", "é é", texts[3]]
    df = clash(docs(make, texts, 10))
    prints = {k: fingerprint_plain(t) for k, t in enumerate(texts, 10)}
    want = groups_plain(prints, 2)
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {d: (prints[d], want[d]) for d in prints}
    assert simhash.near_duplicates(make(DOCS, [])).count() == 0


@pytest.mark.parametrize("bucket", [2, 64])
@pytest.mark.parametrize("k", [1, 2])
def test_links_connect_all_close_pairs_whatever_the_bucket(make, bucket, k):
    rng = random.Random(bucket + k)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base[:6]:  # crowds around one point, as near copies make them
        for _ in range(60):
            x = b
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = simhash.links(make("fp long", [(x,) for x in signed]), k, bucket).collect()
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= k for r in edges)
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in edges:
        parent[find(r["a"])] = find(r["b"])
    for a, b in combinations(signed, 2):
        if ((a ^ b) % (1 << 64)).bit_count() <= k:
            assert find(a) == find(b)


def near_copy(rng, text, share):
    return " ".join(w if rng.random() > share else f"changed{rng.randint(0, 10**6)}" for w in text.split())


def test_dropping_near_duplicates(make):
    rng = random.Random(8)
    clean = [sentence(rng, rng.randint(40, 400)) for _ in range(60)]
    copies = [(100 + k, near_copy(rng, clean[k], 0.005)) for k in range(30)] + [(200 + k, clean[k]) for k in range(30)]
    rows = [(k, t) for k, t in enumerate(clean)] + copies + [(300, ""), (301, None), (302, ""), (5, clean[5]), (None, "a"), (None, "a")]
    out = similar.drop_near_duplicates(clash(make(DOCS, [(k, t, "en", "s", 0) for k, t in rows])))
    kept = [r["doc_id"] for r in out.collect()]
    assert set(range(60)) <= set(kept) and kept.count(5) == 1
    assert kept.count(None) == 2
    assert [k for k in kept if k is not None and 300 <= k] == [300]
    assert not [k for k in kept if k is not None and 200 <= k < 300]
    assert len([k for k in kept if k is not None and 100 <= k < 200]) <= 2


def test_a_large_group_of_near_copies_stays_one(make):
    rng = random.Random(2)
    base = sentence(rng, 300)
    rows = [(k, near_copy(rng, base, 0.004), "en", "s", 0) for k in range(300)]
    assert [r["doc_id"] for r in similar.drop_near_duplicates(make(DOCS, rows)).collect()] == [0]


def far_copies(rng, count, words, changed):
    """A text and copies with ``changed`` words replaced by new ones: similar to the text, not to each other."""
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(words)]
    copies = []
    for _ in range(count):
        new = list(base)
        for k in rng.sample(range(0, words - 8, 8), changed):
            new[k + 4] = f"c{rng.randint(0, 10**9)}"
        copies.append(" ".join(new))
    return " ".join(base), copies


def test_copies_of_an_original_with_the_largest_id(make):
    base, copies = far_copies(random.Random(12), 400, 300, 5)
    near = [similar.similarity(base, c) for c in copies]
    assert min(near) >= 0.8 and np.mean([similar.similarity(a, b) >= 0.8 for a, b in combinations(copies[:40], 2)]) < 0.1
    rows = [(k, c, "en", "s", 0) for k, c in enumerate([*copies, base])]
    assert [r["doc_id"] for r in similar.drop_near_duplicates(make(DOCS, rows)).collect()] == [0]


def test_an_id_with_different_texts(make):
    rng = random.Random(4)
    a, b, c = (sentence(rng, 200) for _ in range(3))
    rows = [(1, a), (5, near_copy(rng, a, 0.004)), (5, b), (7, b), (8, c), (8, c), (8, a)]
    out = similar.drop_near_duplicates(make(DOCS, [(k, t, "en", "s", 0) for k, t in rows]))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted([(1, a), (5, b), (8, c)])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 1400), st.integers(0, 2**32))
def test_prefixes_of_similar_sets_meet_and_bounds_hold(n, seed):
    """Nothing here depends on the number of documents, so the candidates are complete at every size."""
    rng = random.Random(seed)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    a = " ".join(words)
    for k in rng.sample(range(n), rng.randint(0, n // 20)):
        words[k] = f"c{rng.randint(0, 10**6)}"
    b = " ".join(words)
    (h, _, _, p, x), (g, _, _, q, y) = similar.set_sketch(a), similar.set_sketch(b)
    common = np.sort(rng.sample(list(h), len(h) // 2)).astype(np.uint64)
    fold = lambda bits, size: bits if len(bits) <= size else bits[:size] ^ bits[size:]
    both = min(len(x), len(y))
    coarse = sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(p, q))
    fine = int(np.bitwise_count((fold(x, both) ^ fold(y, both)).view(np.uint64)).sum()) if both else 0
    parted = max(coarse, fine)
    assert parted <= len(np.setxor1d(h, g))
    assert [len(x) > 0, len(y) > 0] == [len(h) > 512, len(g) > 512]
    if similar.similarity(a, b) >= 0.8:
        assert parted <= 0.2 / 1.8 * (len(h) + len(g)) + 1e-6
        for last in (None, common):
            assert set(similar.prefix(h, 0.8, last).tolist()) & set(similar.prefix(g, 0.8, last).tolist())


def test_every_pair_just_above_the_threshold_is_found(make):
    rng = random.Random(21)
    rows = []
    for k in range(300):
        base, (copy,) = far_copies(rng, 1, 290, 6)
        assert 0.8 <= similar.similarity(base, copy) < 0.82
        rows += [(2 * k, base, "en", "s", 0), (2 * k + 1, copy, "en", "s", 0)]
    assert sorted(r["doc_id"] for r in similar.drop_near_duplicates(make(DOCS, rows)).collect()) == list(range(0, 600, 2))


def test_near_dedup_is_simhash_before_anything_else(make, spark, monkeypatch):
    """Copies within two bits are linked through SimHash's own blocks, also if nothing comes after them; unlike texts of one fingerprint are not."""
    rng = random.Random(17)
    texts = [sentence(rng, 400) for _ in range(40)]
    texts += [near_copy(rng, t, 0.003) for t in texts] + [near_copy(rng, t, 0.02) for t in texts]
    texts += ["much the same " * 300 + "one two three four five six", "much the same " * 300 + "seven eight nine ten eleven twelve thirteen", "", None]
    prints = [fingerprint_plain(t) for t in texts]
    assert prints[120] == prints[121] and similar.similarity(texts[120], texts[121]) < 0.8
    group = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2 and similar.similarity(texts[a], texts[b]) >= 0.8:
            group = [group[a] if g == group[b] else g for g in group]
    want = sorted({group.index(g) for g in group})
    assert 44 < len(want) < 120
    seen = []

    def links(distinct, *args, plain=simhash.links):
        seen.append({r["fp"] % (1 << 64) for r in distinct.collect()})
        return plain(distinct, *args)

    monkeypatch.setattr(simhash, "links", links)
    monkeypatch.setattr(similar, "prefix", lambda hashes, share, common=None: hashes[:0])
    alone = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs(make, texts), "").collect())
    assert {120, 121} <= set(want) and alone == want and seen == [set(prints)]


# --- decontamination ----------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits_plain(texts, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = {}
    for d, t in texts:
        w, hit, of = WORD.findall(low(t)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    of |= windows[tuple(w[k : k + size])]
        out[d] = (len(w), len(hit), sorted(of))
    return out


@pytest.mark.parametrize("block", [2_000_000, 7])
def test_decontamination(make, block):
    rng = random.Random(4)
    items = [(k, sentence(rng, n)) for k, n in enumerate((3, 10, 14, 30, 1, 30))] + [(6, None), (7, ""), (8, "?!"), (3, "x y z"), (None, "q q")]
    texts = []
    for k in range(30):
        inner = rng.choice(items[:6])[1].upper().replace(" ", rng.choice([" ", "\n", "-", ", "]))
        texts.append((k, f"{sentence(rng, 8)} {inner if k % 3 else ''} {sentence(rng, 5)}"))
    texts += [(40, None), (41, ""), (42, "...")]
    df = clash(make(DOCS, [(k, t, "en", "s", 0) for k, t in texts]))
    found = decontam.find_contamination(df, make("item_id long, text string", items), block_windows=block)
    got = {r["doc_id"]: (r["contamination"]["n_words"], r["h"], r["contamination"]["items"]) for r in found.withColumn("h", decontam.n_hit()).collect()}
    assert got == hits_plain(texts, [x for x in items if x[0] is not None])
    nothing = decontam.find_contamination(df, make("item_id long, text string", []))
    assert nothing.where(decontam.n_hit() > 0).count() == 0
    assert decontam.find_contamination(make(DOCS, []), make("item_id long, text string", items)).count() == 0


def test_removing_spans(make):
    rng = random.Random(9)
    item = " ".join(f"w{k}" for k in range(12))
    head, tail = sentence(rng, 20), sentence(rng, 20)
    texts = [f"{head}. {item.upper()}! {tail}", head, item, f"{item} and a bit"]
    bench = make("item_id long, text string", [(1, item)])
    got = {r["doc_id"]: r["text"] for r in decontam.remove_contamination(clash(docs(make, texts)), bench).collect()}
    assert got == {0: f"{head}. {tail}", 1: head}
    more = {r["doc_id"]: r["text"] for r in decontam.remove_contamination(clash(docs(make, texts)), bench, block_windows=1).collect()}
    assert more == got
    assert [r["doc_id"] for r in decontam.remove_contamination(docs(make, texts), bench, action="documents").collect()] == [1]


# --- chat ---------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "a\\b\\\\<[", "", None, "<\\|", "[\\", "日本😀", "x\ny"]


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", f"rules {c} " * rng.randint(1, 5)))
        for t in range(1, rng.randint(2, 60)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant"]), rng.choice(NASTY) if rng.random() < 0.3 else sentence(rng, rng.choice([1, 5, 20, 90]))))
    return rows + [(None, None, None, None), (None, 1, "assistant", "null conversation"), (77, 3, "system", "late"), (77, 2, "user|>[x", "odd role"), (77, 2, "user|>[x", "odd role")]


@pytest.mark.parametrize(("budget", "history", "run"), [(2048, 256, 256), (200, 40, 4), (60, 0, 3), (4, 2, 1)])
def test_chat_windows(make, budget, history, run):
    rows = conversations(budget)
    out = chat.format_conversations(clash(make(TURNS, rows)), budget, history, run)
    windows = out.collect()
    read = {(r["conv_id"], r["window"]): r for r in chat.read_back(out).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for c, own in by.items():
        own.sort()
        parts = sorted((w for w in windows if w["conv_id"] == c), key=lambda w: w["window"])
        turns = [(t["role"], t["text"]) for w in parts for t in read[c, w["window"]]["turns"]]
        assert turns == [x[2:] for x in own]
        assert [x for w in parts for x in read[c, w["window"]]["loss_texts"]] == [x[3] for x in own if x[2] == "assistant"]
        for w in parts:
            assert "</s>" not in w["formatted"] and "[INST]" not in w["formatted"]
            if own[0][2] == "system":
                assert w["formatted"].startswith("<|system|>\n" + re.sub(r"([<\[\\])", r"\1\\", own[0][3]))
            if w["over"]:
                assert len(read[c, w["window"]]["turns"]) == 1 or budget < 60
            else:
                assert w["n_tokens"] <= budget
    assert chat.format_conversations(make(TURNS, [])).count() == 0


def test_chat_windows_whatever_the_turn_numbers(make):
    """Time stamps as turn numbers, and conversations of many runs: the same windows, and history over the ends of runs."""
    rng = random.Random(2)
    rows = [(c, t, "system" if t == 0 else rng.choice(["user", "assistant"]), sentence(rng, rng.choice([1, 4, 9]))) for c in range(3) for t in range(90)]
    sparse = [(c, 10**12 + t * t * 997, r, x) for c, t, r, x in rows]
    shape = lambda r, n: sorted((w["conv_id"], w["window"], w["formatted"], w["n_repeated"]) for w in chat.format_conversations(make(TURNS, r), 200, 60, n).collect())
    dense = shape(rows, 16)
    assert shape(sparse, 16) == dense
    starts = {(c, w): n for c, w, _, n in dense}
    for c in range(3):
        for k in range(16, 90, 16):
            before = [chat_tokens(x) for _, _, _, x in rows[90 * c : 90 * c + k]]
            want = next((n for n in range(len(before)) if sum(before[-n - 1 :]) > 60), len(before))
            assert starts[c, k] == 1 + want


def chat_tokens(text):
    return -(-(len(text) + 2 * (len(text.encode()) - len(text))) // 4) + 4


# --- toxicity -----------------------------------------------------------------------------------------------------


def insults(rng, n, toxic):
    words = ["".join(rng.choices("bdfgklmnprst", k=1) + rng.choices("aeiou", k=1)) * rng.randint(1, 2) + rng.choice("nrst") for _ in range(n)]
    if toxic:
        for _ in range(4):
            base = rng.choice(["grobnax", "wuzzlik"])
            words[rng.randrange(n)] = base if rng.random() < 0.5 else base[:3] + rng.choice("aeiou") + base[3:]
    return " ".join(words)


def test_toxicity(make):
    rng = random.Random(6)
    rows = [(k, insults(rng, rng.choice([20, 60, 300]), k % 4 == 0), None, None, None) for k in range(900)]
    df, labels = make(DOCS, rows), make("doc_id long, quality int, toxic int", [(k, 0, int(k % 4 == 0)) for k in range(900)] + [(5, 0, None), (None, 0, 1), (99999, 0, 1)])
    model = toxicity.fit(df, labels, fold=0)
    more = rows + [(2000, None, None, None, None), (2001, "", None, None, None), (2002, "?!", None, None, None),
                   (2003, insults(rng, 30_000, True), None, None, None), (2004, insults(rng, 40, False) + " grobnaxx wuzlik gorbnax grobnaks", None, None, None)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(clash(make(DOCS, more)), model).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 4 == 0) for k in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    assert got[2000] == got[2001] == got[2002] < 0.5
    assert got[2004] > 0.5  # misspelt in ways never seen
    assert toxicity.score_documents(make(DOCS, []), model).count() == 0


@pytest.mark.parametrize(("labels", "want"), [([], 0.0), ([(0, 0, 0)], 0.0), ([(0, 0, 1)], 1.0)])
def test_toxicity_without_both_classes(make, labels, want):
    df = docs(make, ["some words", None])
    model = toxicity.fit(df, make("doc_id long, quality int, toxic int", labels))
    assert {r["score"] for r in toxicity.score_documents(df, model).collect()} == {want}


def test_toxicity_pieces_of_training(monkeypatch):
    rng = random.Random(9)
    texts, ys = [insults(rng, 40, k % 3 == 0) for k in range(120)] + [None, "", "?!"], [int(k % 3 == 0) for k in range(120)] + [0, 1, 0]
    whole = toxicity.train(texts, ys, epochs=5)
    cut = toxicity.slabs
    monkeypatch.setattr(toxicity, "slabs", lambda n: cut(n, 7))
    pieces = toxicity.train(texts, ys, epochs=5)
    assert whole.weight.any() and np.allclose(whole.weight, pieces.weight, atol=1e-4) and abs(whole.bias - pieces.bias) < 1e-6
    assert not toxicity.train([None, "?!"], [0, 1]).weight.any()


# --- packing ------------------------------------------------------------------------------------------------------


def check_plan(histogram, capacity):
    runs = packing.plan(histogram, capacity)
    places = defaultdict(list)
    ranks = defaultdict(list)
    for l, r0, n, s, each, o in runs.tolist():
        for k in range(n):
            places[s + k // each].append((o + k % each * l, l))
            ranks[l].append(r0 + k)
    assert {l: sorted(x) for l, x in ranks.items()} == {l: list(range(n)) for l, n in histogram.items() if n}
    for own in places.values():
        at = 0
        for o, l in sorted(own):
            assert o == at
            at += l
        assert at <= capacity
    return len(places)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 60), max_size=20))
def test_plan_places_everything_once(histogram):
    used = check_plan(histogram, 64)
    total = sum(l * n for l, n in histogram.items())
    # The tokens bound it from below only (two of 33 never share 64); from above, first fit of the longest first.
    rooms = []
    for l in sorted((l for l, n in histogram.items() for _ in range(n)), reverse=True):
        k = next((k for k, r in enumerate(rooms) if r >= l), None)
        if k is None:
            rooms.append(64 - l)
        else:
            rooms[k] -= l
    assert -(-total // 64) <= used <= 1.1 * len(rooms) + 3


def test_plan_is_near_the_bound_and_small():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1, 200_000).astype(int) + 1)
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
    runs = packing.plan(histogram, 4096)
    assert len(runs) < 60_000
    used = runs[:, 3].max() + 1
    assert used <= 1.002 * -(-lengths.sum() // 4096)
    thirds = check_plan({1366: 900, 1365: 900, 2048: 500, 10: 5}, 4096)
    assert thirds <= 1.01 * -(-(1366 * 900 + 1365 * 900 + 2048 * 500 + 50) // 4096) + 160


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="abcXÉß'.,!?-_0129 \n\t\r\x0b\x1c\x85\xa0 日😀İΣςé́<|>", max_size=50))
def test_encoder_is_the_tokenizer(text):
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids if not hasattr(test_encoder_is_the_tokenizer, "t") else test_encoder_is_the_tokenizer.t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(PATH)(text), "<u4").tolist() == want


test_encoder_is_the_tokenizer.t = Tokenizer.from_file(PATH)


def test_encoder_for_every_letter_before_a_mark():
    encode, plain = packing.Encoder(PATH), lambda t: test_encoder_is_the_tokenizer.t.encode(t, add_special_tokens=False).ids
    letters = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    for chunk in [f"{c}{mark}" for c in letters for mark in ".,"] + ["TARİHİ,", "ab\u0958.", "İ."]:
        assert np.frombuffer(encode(chunk), "<u4").tolist() == plain(chunk), chunk


def test_packing(make):
    rng = random.Random(11)
    texts = [sentence(rng, rng.choice([0, 1, 5, 40, 300])) for _ in range(150)] + [None, "", "don't <|endoftext|> it's", sentence(rng, 2500), "a " * 9000, "Hello,World. x.,y"]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)] + [(3, texts[3], None, None, None), (None, "null id", None, None, None)]
    got = packing.pack_documents(clash(make(DOCS, rows)), PATH, 512).collect()
    want = []
    for k, t, *_ in rows:
        ids = np.array([*test_encoder_is_the_tokenizer.t.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(k, p, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes())) for p, a in enumerate(range(0, len(ids), 512))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    assert all(zlib.crc32(r["tokens"]) == r["ids_crc32"] for r in got)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 512
    assert len(places) <= 1.05 * -(-sum(x[3] for x in want) // 512) + 1
    assert packing.pack_documents(make(DOCS, []), PATH).count() == 0


def test_ranks_with_salts(make):
    pieces = make("doc_id long, piece int, start long, length long, __mixed long", [(k // 300, 0, 0, 1 + k % 3, k * 7919) for k in range(500)])
    placed = packing.assign(pieces, 8, salt_rows=20).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in placed}) == 500


# --- HTML ---------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="ad">Buy this now, really.</div><div class="cookie-notice"><p>We use cookies on this page.</p></div>
<article><h1>A &amp; B</h1><p>First  para <b>bold</b>graph,
with&nbsp;words enough to be a text.<p>Second &lt;one&gt; &#233; and &copy; more words for it.<br>After</p></article>
<aside><h3>Related</h3><ul><li><a href=/c>Other</a></li></ul></aside><section class="comments"><div class="comment"><p>I disagree with all of it.</p></div></section>
<form><input name=q><button>Go</button></form><footer>&copy; 2020 example, all rights.</footer></body></html>"""


@pytest.fixture(scope="module")
def model():
    return htmltext.default_model()


def test_main_text(model):
    assert htmltext.extract(PAGE, model).split("\n") == ["A & B", "First para boldgraph, with words enough to be a text.", "Second <one> é and © more words for it. After"]


def test_held_out_layouts(model):
    good = bad = missed = 0
    for page, main in htmltext.labelled_pages(150, seed=77):
        words = htmltext.extract(page, model).split()
        own = sum(w in main for w in words)
        good, bad = good + own, bad + len(words) - own
        missed += sum(w in main for _, kind, t in htmltext.parse(page)[1] if kind for w in t.split()) - own
    assert good / (good + bad) > 0.97
    assert good / (good + max(0, missed)) > 0.97


def test_marginals_are_those_of_the_joint(model):
    """Sum-product against the sum over all states of a small tree."""
    nodes, events = htmltext.parse("<div><p>one two</p><ul><li>x</li><li><a href=/>y</a></li></ul></div>")
    rows, edge, parent, _ = htmltext.featurize(nodes, events)
    n = len(nodes)
    total, on = 0.0, np.zeros(n)
    for s in range(1 << n):
        y = [s >> k & 1 for k in range(n)]
        p = np.exp(sum(model.unary[rows[k]].sum() * y[k] for k in range(n)) + sum(model.pair[edge[k], y[parent[k]], y[k]] for k in range(1, n)))
        total += p
        on += p * np.array(y)
    assert np.allclose(htmltext.marginals(rows, edge, parent, model), on / total)


@pytest.mark.parametrize("page", ["", None, "<", "<p", "</p></div>", "<!-- open", "<div " + "x" * 1000, "<a href='", "<script>", "&#xD800;&#1114112;&am", "<div>" * 3000 + "deep", "a < b > c"])
def test_broken_pages(model, page):
    assert isinstance(htmltext.extract(page, model), str)


def test_pages(make, model):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "just  text"), (1, "u", PAGE)]
    got = htmltext.extract_pages(clash(make("page_id long, url string, html string", rows)), model)
    texts = sorted((r["page_id"], r["text"]) for r in got.collect())
    assert texts[0] == texts[1] and texts[2:] == [(2, ""), (3, ""), (4, "just text")]
    assert htmltext.extract_pages(make("page_id long, url string, html string", []), model).count() == 0


def test_fine_bits_of_long_texts_tell_pairs(make):
    """Long texts that share a passage but are not similar, and copies of them, one in each size of bits."""
    rng = random.Random(5)
    word = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    passage, rows = word(500), []
    for k in range(12):
        own = word(rng.choice([700, 1400, 3000]))
        rows += [(k, " ".join(own[:300] + passage + own[300:])), (100 + k, " ".join(own[:300] + passage + own[300:] + word(len(own) // 8)))]
    kept = {r["doc_id"] for r in similar.drop_near_duplicates(make(DOCS, [(k, t, "en", "s", 0) for k, t in rows])).collect()}
    assert kept == set(range(12))


#: Pages written by hand with their main text; the class names of the first ones are in no list of the operator.
BY_HAND = [
    ("""<!doctype html><html><head><title>Quiet harbour</title><style>.q{}</style></head><body><div class="zq1"><ul><li><a href="/">Start</a></li><li><a href="/n">News</a></li>
     <li><a href="/c">Contact us</a></li></ul></div><article><h1>The harbour is quiet</h1><p>Nobody had expected the boats to stay away, but on Monday the quay was empty &amp; still.</p>
     <p>“It was odd,” said the pilot.<br>She has worked here for years, and the tide tables hang in her kitchen.</p></article><footer><p>All rights reserved, 2021.</p></footer></body></html>""",
     "The harbour is quiet\nNobody had expected the boats to stay away, but on Monday the quay was empty & still.\n“It was odd,” said the pilot. She has worked here for years, and the tide tables hang in her kitchen."),
    ("""<html><body><header><a href="/">Brand</a><nav><a href="/a">One</a> <a href="/b">Two</a> <a href="/c">Three</a></nav></header><main><h2>Bread without kneading</h2>
     <p>Mix the flour, the water and the salt, and leave the dough alone for a whole night.<p>In the morning fold it twice, and bake it in a pot that is very hot.
     <ul><li>500 g of flour<li>350 g of water<li>10 g of salt</ul></main><aside><h3>More to read</h3><ul><li><a href="/x">Soup</a><li><a href="/y">Cake</a></ul></aside></body></html>""",
     "Bread without kneading\nMix the flour, the water and the salt, and leave the dough alone for a whole night.\nIn the morning fold it twice, and bake it in a pot that is very hot.\n500 g of flour\n350 g of water\n10 g of salt"),
    ("""<body><div id="cookie-notice"><p>We use cookies to make this site better for you.</p><button>Fine</button></div><div class="post-content"><h1>On old clocks</h1>
     <p>A clock that has stopped is right twice a day, which is more than can be said of one that is slow.</p><script>var a = "<p>no</p>";</script>
     <blockquote>Time is what the clock says, and the clock says what it was told.</blockquote></div>
     <div class="comments"><div class="comment"><b>Ann</b><p>I had one of these, and it never worked for longer than a week, sadly.</p></div></div></body>""",
     "On old clocks\nA clock that has stopped is right twice a day, which is more than can be said of one that is slow.\nTime is what the clock says, and the clock says what it was told."),
    ("""<html><body><table><tr><td><a href="1">Home</a> <a href="2">Map</a> <a href="3">Help</a></td></tr></table><article><p>First part of the story, which is long enough to be read as a text, with marks, too.</p><hr>
     <p>Second part, after the line, and it goes on for as long as the first one did, or nearly.</p><figure><img src=a.png><figcaption>The line itself, seen from the north side.</figcaption></figure></article>
     <form action="/s"><label>Search</label><input name=q><button>Go</button></form></body></html>""",
     "First part of the story, which is long enough to be read as a text, with marks, too.\nSecond part, after the line, and it goes on for as long as the first one did, or nearly.\nThe line itself, seen from the north side."),
    ("<p>A text without any page around it, as it is found in many a file.</p><p>It has two paragraphs, and nothing else.</p>",
     "A text without any page around it, as it is found in many a file.\nIt has two paragraphs, and nothing else."),
    ("Only words, no markup at all &lt;here&gt;", "Only words, no markup at all <here>"),
    ("""<html><body><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav><SCRIPT>if (1 < 2) { "İİİİ" }</ScRiPt ><article><h1>Kısa bir yazı</h1><p>İstanbul'da hava güzeldi, deniz de öyle, ve herkes dışarıdaydı.</p>
     <script>x</script><p>Akşam olunca herkes evine döndü, sokaklar da boş kaldı.</p></article></body></html>""",
     "Kısa bir yazı\nİstanbul'da hava güzeldi, deniz de öyle, ve herkes dışarıdaydı.\nAkşam olunca herkes evine döndü, sokaklar da boş kaldı."),
]


@pytest.mark.parametrize("page", range(len(BY_HAND)))
def test_pages_written_by_hand(model, page):
    assert htmltext.extract(BY_HAND[page][0], model) == BY_HAND[page][1]


@pytest.mark.parametrize("html", ["<div>one<p></p>two</div>", "one<div><img></div>two", "one<figure><svg><path/></svg></figure>two", "<p>one<hr>two</p>", "<div>one<ul></ul>two</div>",
                                  "<div>one<hr/>two</div>"])
def test_blocks_without_text_part_what_stands_around_them(html):
    nodes, events = htmltext.parse(html)
    kinds = [text if kind == 1 else kind for _, kind, text in events if kind != 0]
    assert 2 in kinds[kinds.index("one") + 1 : kinds.index("two")]
    everything = htmltext.Model(np.zeros(len(htmltext._NAMES)), np.zeros((len(htmltext._EDGE), 2, 2)))
    assert htmltext.extract(html, everything) == "one\ntwo"


def test_attributes_are_read_whole():
    assert htmltext._hints(' style="overflow:hidden" data-id="comment" href="?id=ad" title=\'class="menu"\'') == ([], False)
    assert htmltext._hints(' CLASS="comment" aria-hidden=true') == (["talk"], True)
    assert htmltext._hints(" hidden")[1] and not htmltext._hints(' aria-hidden="false"')[1]


def test_raw_text_ends_where_it_ends(model):
    for filler in ("I", "İ"):
        nodes, events = htmltext.parse(filler * 20 + "<p>one</p><script>a</scripty>b</SCRIPT ><p>two</p><style>c</style><p>three</p>")
        assert [t for _, k, t in events if k == 1 and t.strip() and "a" not in t and "c" not in t] == [filler * 20, "one", "two", "three"]


def test_parsing_is_linear_in_open_elements():
    began = time.perf_counter()
    for page in ("<i>" * 30_000 + "</b>" * 30_000, "<b><div>" + "<i>" * 30_000 + "</b>" * 30_000, "<ul>" + "<li><i>" * 30_000, "<table>" + "<td>" * 30_000, "<div>" * 30_000 + "<p>" * 30_000):
        htmltext.parse(page)
    assert time.perf_counter() - began < 20
