"""Language identification by compression with per-language dictionaries.

A raw-content zstandard dictionary per language is cut from labelled texts. A
text is compressed once with each dictionary, block by block so that a long
text cannot drown the dictionary in its own repetitions; the language whose
dictionary gives the smallest total wins. Letters alone carry a language, so
everything between them counts as one blank. If the runner-up is within the
margin, the operator rejects: lang is ``und``, while ``best`` still names the
winner.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
rows without a language are never learned from; with no learned language all
texts are ``und``; ties go to the language with more learned rows, then to the
first in alphabetical order; repeated rows are classified row by row.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import crc32_mod, held, prepare_python

UND = "und"


#: ASCII bytes with a blank for all but letters.
_ASCII = bytes(b if b < 128 and chr(b).isalpha() else 32 for b in range(256))
_BETWEEN = re.compile(r"[\W\d_]+")
_FAR = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(1)
def _numbers() -> tuple[re.Pattern, re.Pattern]:
    """The numbers other than digits that ``\\w`` takes in, up to U+FFFF and beyond.

    Sets of their own: with a category, or with anything beyond U+FFFF, the whole set is gone through for every letter.
    """
    numbers = [c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
    near, far = ("".join(c for c in numbers if (c > "\uffff") == beyond) for beyond in (False, True))
    return re.compile(f"[{near}]"), re.compile(f"[{far}]")


def letters(text: str | None) -> bytes:
    """The lower-cased text with one blank for everything between letters (category L)."""
    if not text:
        return b""
    text = text.lower()
    if text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split())
    near, far = _numbers()
    text = near.sub(" ", text)
    if _FAR.search(text):
        text = far.sub(" ", text)
    return _BETWEEN.sub(" ", text).strip().encode("utf-8", "surrogatepass")


class Classifier:
    def __init__(self, contents: dict[str, bytes], block: int = 2048, level: int = 6):
        self.langs = list(contents)
        self.block = block
        self.packers = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(dict_data=content, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> np.ndarray:
        """Compressed bytes of the whole text for each language."""
        blocks = [raw[k : k + self.block] for k in range(0, len(raw), self.block)]
        return np.array([sum(len(p.compress(b)) for b in blocks) for p in self.packers], np.int64)

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(best language, score, margin): the margin is the share by which the runner-up is larger."""
        raw = letters(text)
        if not raw or not self.langs:
            return UND, 0.0, 0.0
        size = self.sizes(raw)
        order = np.argsort(size, kind="stable")
        best = size[order[0]]
        margin = float(size[order[1]] - best) / float(best) if len(order) > 1 else 1.0
        # A softmax over bits saved, tempered by the length: narrow margins come out near one half.
        gain = (size - best) / max(1.0, float(best)) * 20
        return self.langs[order[0]], float(1 / np.exp(-gain).sum()), margin


def learn(docs: DataFrame, *, docs_per_lang: int = 256, chars_per_doc: int = 1024, dict_bytes: int = 112_640, even_from: int = 65_536, max_langs: int = 256, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang", fold: int | None = None, folds: int = 4) -> dict[str, bytes]:
    """Dictionary content per language from a bounded sample of labelled texts.

    The sample is at most ``docs_per_lang`` different texts of each language, first by a hash of id and text, and of each
    a passage of ``chars_per_doc`` characters from a place drawn from the same hash. Rows of the fold ``fold`` are left
    out. The ``max_langs`` most frequent languages are learned. A larger dictionary would win by size alone, so all get
    the size of the smallest; languages with less than ``even_from`` bytes keep what they have and do not cut the others.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    if fold is not None:
        known = known.where(crc32_mod(F.col(id_col), folds) != fold)
    known = (known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(5), F.col(text_col)).alias("mixed"))
             .select("lang", "mixed", F.substring(F.col("text"), F.pmod("mixed", F.greatest(F.lit(1), F.length("text") - chars_per_doc)).cast("int") + 1, F.lit(chars_per_doc)).alias("passage")))
    counts = {r["lang"]: (r["n"], r["different"]) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("mixed").alias("different"))
              .orderBy(F.col("n").desc(), "lang").limit(max_langs).collect()}
    contents = {}
    if not counts:
        return contents
    # Hashes are uniform, so a threshold per language keeps little more than the sample before anything is sorted.
    share = F.create_map(*[F.lit(x) for l, (_, n) in sorted(counts.items()) for x in (l, min(1.0, (2.0 * docs_per_lang + 50) / n))])
    near = known.where(F.pmod("mixed", F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")) * 1_000_000)
    # Rows of one id and text are one of the sample, however many there are.
    once = near.groupBy("lang", "mixed").agg(F.min("passage").alias("passage"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("mixed", "passage"))
    by: dict[str, list] = {}
    for r in sorted(once.withColumn("nth", nth).where(F.col("nth") <= docs_per_lang).collect(), key=lambda r: (r["lang"], r["nth"])):
        by.setdefault(r["lang"], []).append(letters(r["passage"]))
    whole = {lang: b"\n".join(passages) for lang, passages in by.items()}
    size = min([dict_bytes, *(len(x) for x in whole.values() if len(x) >= even_from)])
    return {lang: whole[lang][:size] for lang in sorted(whole, key=lambda x: (-counts[x][0], x)) if len(whole[lang]) >= 8}


def identify(docs: DataFrame, contents: dict[str, bytes], *, min_margin: float = 0.01, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct column ``out``: lang (``und`` if rejected), best, score, margin."""
    prepare_python(docs.sparkSession)
    sent, key = docs.sparkSession.sparkContext.broadcast(contents), uuid.uuid4().hex

    @F.pandas_udf("lang string, best string, score double, margin double")
    def classify(texts: pd.Series) -> pd.DataFrame:
        classifier = held(key, lambda: Classifier(sent.value))
        found = [classifier(t) for t in texts]
        return pd.DataFrame({"lang": [b if m >= min_margin else UND for b, _, m in found], "best": [b for b, _, _ in found],
                             "score": [s for _, s, _ in found], "margin": [m for _, _, m in found]})

    return docs.withColumn(out, classify(F.col(text_col)))
