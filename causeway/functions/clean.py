"""Text cleaning that built-in functions can't express, as Arrow functions over whole columns.

A column is cleaned by a list of kernels, each a vectorised replacement. They run until a value stays as it is; only
values that changed are run again, so a batch costs what its deepest escapes cost. RE2 keeps every pattern linear.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType

#: Elements without text of their own, and elements that begin a line.
HIDDEN = ("script", "style", "iframe", "head", "noscript")
LINES = ("p", "div", "br", "li", "tr")


def _swap(pattern: str, by: str) -> Callable[[pa.Array], pa.Array]:
    return lambda texts: pc.replace_substring_regex(texts, pattern, by)


def _where(pattern: str, change: Callable[[str], str]) -> Callable[[pa.Array], pa.Array]:
    """A change that Arrow has no kernel for, made only in values where ``pattern`` is found."""

    def run(texts: pa.Array) -> pa.Array:
        found = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
        if not pc.any(found).as_py():
            return texts
        return pc.replace_with_mask(texts, found, pa.array([change(x) for x in texts.filter(found).to_pylist()], texts.type))

    return run


def one_byte(text: str) -> bytes:
    """The bytes that text was when it was read as Windows-1252, whose five gaps stand for themselves."""
    return b"".join(bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252") for c in text)


def _misread() -> str:
    """Characters that the lead bytes of Latin letters and typographic marks become when UTF-8 is read byte by byte, followed by as many others as such a sequence has."""
    follow = "".join(sorted({bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xC0)} | {chr(b) for b in range(0x80, 0xC0)}))
    follow = "[" + re.sub(r"([\\\]^-])", r"\\\1", follow) + "]"
    return f"(?:[\u00c2\u00c3]{follow}|\u00e2{follow}{{2}})+"


MISREAD = _misread()


def _reread(text: str) -> str:
    def run(m: re.Match) -> str:
        try:
            return one_byte(m.group()).decode()
        except UnicodeDecodeError:
            return m.group()

    return re.sub(MISREAD, run, text)


#: Arrow's own kernel leaves letters decomposed.
composed = _where(r"[^\x00-\x{ff}]", lambda x: unicodedata.normalize("NFC", x))

#: Each is applied to the whole column; none of them needs to know where it stands in the list for the end result.
KERNELS: tuple[Callable[[pa.Array], pa.Array], ...] = (
    _where("&", html.unescape),
    _where(MISREAD, _reread),
    _swap("(?is)" + "|".join(rf"<{e}\b[^>]*>.*?(?:</{e}\s*>|\z)" for e in HIDDEN), ""),
    _swap(r"(?s)<!--.*?(?:-->|\z)", ""),
    _swap(rf"(?i)</?(?:{'|'.join(LINES)})\b[^<>]*>", "\n"),
    _swap(r"</?[A-Za-z][^<>]*>|<![A-Za-z][^<>]*>", ""),
)
#: Once, after the kernels.
LAYOUT: tuple[Callable[[pa.Array], pa.Array], ...] = (
    composed,
    _swap(r"\r\n?", "\n"),
    _swap(r"\A\x{feff}+", ""),
    _swap(r"[\x00-\x08\x0e-\x1f\x7f-\x{9f}\t\v\f\p{Z}]+", " "),
    _swap(r" *\n[ \n]*", "\n"),
    _swap(r"\A[ \n]+|[ \n]+\z", ""),
)
#: What a whole page begins with, whatever comments or declarations come before.
PAGE = r"(?is)\A\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<(?:!doctype\s+html|html|head|body)\b"


def cleaned(texts: pa.Array, rounds: int = 8) -> pa.Array:
    """Null counts as empty. A whole page is no article text, and what is still changing after ``rounds`` rounds isn't either: both give an empty text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    busy = pa.array(range(len(texts)), pa.int32())  # places of values that may change still
    for _ in range(rounds):
        if not len(busy):
            break
        before = texts.take(busy)
        after = pc.replace_with_mask(before, pc.match_substring_regex(before, PAGE), pa.scalar("", pa.string()))
        for kernel in KERNELS:
            after = kernel(after)
        changed = pc.not_equal(before, after)
        texts = _put(texts, busy, after)
        busy = busy.filter(changed)
    texts = _put(texts, busy, pa.array([""] * len(busy), pa.string()))
    for kernel in LAYOUT:
        texts = kernel(texts)
    return texts


def _put(texts: pa.Array, places: pa.Array, values: pa.Array) -> pa.Array:
    if not len(places):
        return texts
    order = pa.array(range(len(texts)), pa.int32())
    at = pc.index_in(order, places)
    return pc.if_else(pc.is_valid(at), values.take(pc.fill_null(at, 0)), texts)


@F.arrow_udf(StringType())
def clean_text(text: pa.Array) -> pa.Array:
    return cleaned(text)


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    return composed(text.cast(pa.string()))


#: What speaks against a sentence, by reason: columns over the sentence. ``notices`` of :func:`assess_text` are one more.
FAULTS: dict[str, Callable[[Column], Column]] = {
    "markup_or_script_residue": lambda s: s.rlike(r"</?[A-Za-z][^<>]{0,400}>") | s.rlike(r"\bfunction\b[^.;]{0,40}\(|\b(?:var|let|const)\s+[\w$]+\s*="),
    "no_linguistic_content": lambda s: ~s.rlike(r"\p{L}"),
    "suspected_mojibake": lambda s: s.rlike(MISREAD) | s.contains("\u00ef\u00bb\u00bf"),
    "unrecoverable_encoding": lambda s: s.contains("\ufffd"),
}
NOTICES = ("accept all cookies", "all rights reserved", "cookie policy", "our newsletter")


def assess_text(docs: DataFrame, id_col: str, text_col: str, notices: Sequence[str] = NOTICES) -> DataFrame:
    """docs: a unique id and cleaned text. id, status, reasons, usable.

    A sentence with a fault is refused, for every fault that it has; so is one that holds a notice, and one that a sentence without fault before it equals but
    for case. A text is usable if none is refused, rejected if none is left, else partial; ``reasons`` of those refused, sorted; ``usable``: the sentences left,
    by line breaks. Texts with nothing in them are rejected. No sentence is compared with another but by its key, so long texts cost no more than their length.
    """
    parts = F.filter(F.transform(F.split(text_col, r"(?<=[.!?])\s+|(?<=[。！？])|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    spans = docs.select(F.col(id_col), F.posexplode_outer(parts).alias("at", "s"))
    low = F.lower("s")
    checks = {name: fault(F.col("s")) for name, fault in FAULTS.items()} | {"boilerplate": F.coalesce(*[F.when(F.contains(low, F.lit(x)), True) for x in notices], F.lit(False))}
    faults = F.filter(F.array(*[F.when(check, F.lit(name)) for name, check in checks.items()]), lambda x: x.isNotNull())
    judged = spans.withColumns({"faults": faults, "sound": F.size(faults) == 0, "key": low})
    same = Window.partitionBy(id_col, "key").orderBy("at")
    judged = judged.withColumn("faults", F.when(F.col("sound") & (F.row_number().over(same) > 1), F.array(F.lit("repetition"))).otherwise(F.col("faults")))
    told = judged.groupBy(id_col).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("s").isNotNull(), F.col("faults")))))).alias("reasons"),
        F.sort_array(F.collect_list(F.when(F.col("s").isNotNull() & (F.size("faults") == 0), F.struct("at", "s")))).alias("kept"),
        F.count("s").alias("n"),
    )
    reasons = F.when(F.col("n") == 0, F.array(F.lit("empty_or_html_page"))).otherwise(F.col("reasons"))
    status = F.when(F.size("kept") == 0, "rejected").when(F.size("kept") < F.col("n"), "partial").otherwise("usable")
    return told.select(id_col, status.alias("status"), reasons.alias("reasons"), F.array_join("kept.s", "\n").alias("usable"))


@F.pandas_udf(LongType())
def blake_hash(token: pd.Series) -> pd.Series:
    """First 64 bits of BLAKE2b as a signed bigint."""
    return token.map(lambda t: int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "big", signed=True))


#: Tokens whose hashes are kept in a worker.
KEPT = 1 << 18
WORD = re.compile(r"\w+")


class _Hashes(dict):
    """First 64 bits of BLAKE2b of a token, made once while up to KEPT tokens are known."""

    def __missing__(self, token: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        self[token] = h = hashlib.blake2b(token.encode(), digest_size=8).digest()
        return h


_hashes = _Hashes()


def hashed(text: str | None, dims: int = 1024):
    """Hashed bag of tokens with signs: 32 bits of a hash tell the place, one bit more the sign."""
    import numpy as np

    h = np.frombuffer(b"".join(map(_hashes.__getitem__, WORD.findall((text or "").lower()))), [("at", ">u4"), ("sign", "u1"), ("rest", "V3")])
    n = np.bincount(h["at"] % np.int64(dims) + dims * (h["sign"] & np.int64(1)), minlength=2 * dims)
    return (n[dims:] - n[:dims]).astype(float)


#: Texts whose vectors are made and sent at once.
EMBEDDED = 256


def embedder(model: Callable[[list[str]], Sequence[Sequence[float]]] | None = None) -> Callable[[Column], Column]:
    """A function from a text column to unit vectors: of ``model``, a function from texts to vectors that is loaded once in each worker, else hashed tokens."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for batch in texts:
            for at in range(0, len(batch), EMBEDDED):  # vectors of a whole batch would be many times its texts
                t = batch.iloc[at : at + EMBEDDED]
                rows = np.asarray(model([x or "" for x in t]) if model else [hashed(x) for x in t], float)
                scale = np.sqrt((rows * rows).sum(1, keepdims=True)) if len(rows) else 1.0
                yield pd.Series(list((rows / np.where(scale > 0, scale, 1.0)).astype("float32")))

    return run


embed = embedder()
