"""The registered queries without SQL on the smallest tables, held against plain versions of their contracts."""

import hashlib
import html as _html
import os
import re
import sys
import unicodedata
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
import zstandard

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_operators import fingerprint_plain, groups_plain, test_encoder_is_the_tokenizer  # noqa: E402

from loomgraph.llm import htmltext, langid, pii, queries, toxicity  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{DATA}/{name}.parquet").collect()]


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in rows(spark, "documents")}


def test_op1(spark, texts):
    got = {r["doc_id"]: r for r in queries.op1_language(spark, DATA).collect()}
    assert set(got) == set(texts)
    contents = langid.learn(spark.read.parquet(f"{DATA}/documents.parquet"), fold=2)
    packers = [zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                        write_content_size=False, write_checksum=False, write_dict_id=False) for c in contents.values()]
    for d, text in texts.items():
        r = got[d]
        assert r["held_out"] == (fold(d, 4) == 2) and 0 <= r["score"] <= 1
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        raw = " ".join(re.findall(r"[^\W\d_]+", text.lower())).encode()
        size = [sum(len(p.compress(raw[k : k + 2048])) for k in range(0, len(raw), 2048)) for p in packers]
        assert r["lang_pred"] in contents
        # Dictionaries digested beforehand compress a little differently.
        assert size[list(contents).index(r["lang_pred"])] <= 1.01 * min(size) + 4


def test_op3(spark, texts):
    got = {r["doc_id"]: r for r in queries.op3_pii(spark, DATA).collect()}
    key = hashlib.sha256(queries.PII_KEY).digest()
    for d, text in texts.items():
        new, spans = pii.pseudonymise(text, key)
        assert (got[d]["text"], got[d]["n_pii"], got[d]["kinds"]) == (new, len(spans), ",".join(s[2] for s in spans))
        assert pii.restore(new, spans, queries.PII_KEY) == text


def test_op5(spark, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, DATA).collect()}
    prints = {d: fingerprint_plain(t) for d, t in texts.items()}
    of = groups_plain(prints, 2)
    assert got == {d: (f"{prints[d]:016x}", of[d]) for d in texts}


def test_op7(spark):
    turns = defaultdict(list)
    for r in rows(spark, "conversations"):
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["conv_id"]: r for r in queries.op7_chat(spark, DATA).collect()}
    assert set(got) == set(turns)
    for c, own in turns.items():
        own.sort()
        loss = "".join(x for _, role, x in own if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{role}\n{x}\n" for _, role, x in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] >= sum(len(x) + len(role) for _, role, x in own)


def test_op8(spark, texts):
    got = {r["doc_id"]: r for r in queries.op8_toxicity(spark, DATA).collect()}
    model = toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"), fold=0)

    def plain(text):
        words = [w for w, before in zip(*(lambda x: (x, ["", *x]))(re.findall(r"[^\W_]+", (text or "").lower()))) if w != before]
        weight = [float(model.word_weights([w])[0]) for w in words]
        windows = sorted((np.mean(weight[k : k + model.window]) for k in range(0, len(words), model.window)), reverse=True)
        best = windows[: max(model.top, -(-len(windows) * 5 // 100))]
        return 1 / (1 + np.exp(-np.clip((np.mean(best) if best else 0) + model.bias, -40, 40)))

    for d, text in texts.items():
        r = got[d]
        assert r["held_out"] == (fold(d, 5) == 0) and r["predicted"] == int(r["score"] >= 0.5)
        assert abs(r["score"] - (model.prior if model.prior is not None else plain(text))) < 1e-4


def test_op9(spark, texts):
    got, want, places = queries.op9_pack(spark, DATA).collect(), [], defaultdict(list)
    for d, text in texts.items():
        ids = np.array([*test_encoder_is_the_tokenizer.t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    assert len(places) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_op10(spark):
    pages, got = {r["page_id"]: r for r in rows(spark, "pages")}, {r["page_id"]: r for r in queries.op10_main_text(spark, DATA).collect()}
    model = htmltext.default_model()
    assert set(got) == set(pages)
    for i, page in pages.items():
        r = got[i]
        assert (r["url"], r["n_chars"]) == (page["url"], len(r["text"])) and r["text"] == htmltext.extract(page["html"], model)
        flat = re.sub(r"\s+", " ", _html.unescape(re.sub(r"<[^>]*>", " ", page["html"] or "")))
        at = 0
        for line in r["text"].split("\n"):  # every block is of the page, in page order
            words = line.split(" ")
            at = flat.index(words[0], at)
            assert line == line.strip() and "  " not in line
