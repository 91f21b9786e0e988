"""Containment joins by rare grams: which texts hold which needles as a substring, for any number of needles.

Every needle is looked for by one gram of it, the one that the fewest texts hold, in an equi-join; what meets there is tested
by the text itself. Grams are hashes of windows of 1 to 6 or 12 characters, of the widest kind that a needle has. A clash of
hashes adds candidates and loses none. Texts are read three times, however many needles there are: to count
grams, to join on them, and to test candidates. What is broadcast is a bitmap of fixed size.

`mentioned` is for names: those of word characters only are looked for in the distinct words of the texts, of which there are far fewer than texts have
characters. What texts say of other words doesn't leave them: the commonest words that hold no name are known to all tasks, and a bitmap of those that hold one.

Defined results: null and empty needles and null texts are in no row of the result; repeated needles count once; repeated rows stay repeated.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

WIDTHS = (1, 2, 3, 4, 5, 6, 12)
#: Bits of the bitmap that leaves grams of no needle out; a full one leaves all in, and results are the same.
SLOTS = 1 << 24
#: Characters of a text that are hashed at once.
BLOCK = 1 << 18
#: Bytes of candidates that are broadcast to the texts; more of them meet the texts in a shuffle.
HELD = 32 << 20
#: Common words without a needle that are broadcast; rarer ones are told by a bitmap, and those that pass it wrongly meet no needle.
COMMON = 1 << 16
#: Bits of the bitmap of words at most, 16 MiB; distinct words that a task holds, about; and the texts of which one is counted to tell common words.
BITS, WORDS, COUNTED = 1 << 27, 1 << 18, 8
#: Needles shorter than this are in so many words of a text that the text itself is asked.
SHORTEST = 3
#: Characters of words, and bytes of UTF-8 with blanks for all others.
WORD = "0-9A-Za-z_$"
_WORDS = bytes(b if re.match(f"[{WORD}]", chr(b)) else 32 for b in range(256))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _windows(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the windows of each width: wide ones are made of two narrow ones that meet."""
    one = _mixed(codes, np.uint64(1))
    two = _mixed(one[:-1], one[1:])
    three = _mixed(two[:-1], one[2:])
    six = _mixed(three[:-3], three[3:])
    return dict(zip(WIDTHS, (one, two, three, _mixed(two[:-2], two[2:]), _mixed(three[:-2], two[3:]), six, _mixed(six[:-6], six[6:]))))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _blocks(texts: list[str], block: int) -> Iterator[tuple[np.ndarray, dict[int, np.ndarray]]]:
    """Each character's text and the windows, over short texts together and long ones in pieces; windows go on into the next text."""
    first, size = 0, 0
    for n, text in enumerate(texts):
        size += len(text)
        if size >= block or n == len(texts) - 1:
            part = texts[first : n + 1]
            codes, of = _codes("".join(part)), np.repeat(np.arange(first, n + 1), [len(t) for t in part])
            for i in range(0, len(codes), block):
                end = i + block + WIDTHS[-1] - 1
                yield of[i:end], _windows(codes[i:end])
            first, size = n + 1, 0


def width(needle: str) -> int:
    """The widest kind of window that fits."""
    return max(w for w in WIDTHS if w <= len(needle))


def needle_grams(needle: str) -> np.ndarray:
    return np.unique(_windows(_codes(needle))[width(needle)]).view(np.int64)


class Bits:
    """Which grams may be some needle's: a bitmap, and the widths that occur."""

    def __init__(self, rows: Iterable, slots: int):
        self.slots, self.widths = slots, set()
        self.packed = np.zeros(slots // 8, dtype=np.uint8)
        size = min(slots, 1 << 15) // 8  # a bucket of Spark's bitmaps has 32,768 bits
        for w, bucket, bitmap in rows:
            self.widths.add(w)
            self.packed[(bucket - 1) * size : bucket * size] |= np.frombuffer(bitmap, dtype=np.uint8)[:size]

    def teller(self, block: int):
        """A function of texts: the numbers of texts and their distinct grams that pass, sorted."""
        on, mask, widths = np.unpackbits(self.packed, bitorder="little").view(bool), np.uint64(self.slots - 1), sorted(self.widths)

        def tell(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            owners, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
            for of, windows in _blocks(texts, block):
                for w in widths:
                    g = windows[w]
                    at = np.flatnonzero(on[(g & mask).astype(np.int64)])
                    at = at[of[at] == of[at + w - 1]]  # inside of one text
                    owners.append(of[at])
                    found.append(g[at])
            owner, gram = np.concatenate(owners), np.concatenate(found)
            order = np.lexsort((gram, owner))
            owner, gram = owner[order], gram[order]
            new = np.ones(len(gram), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
            return owner[new], gram[new].view(np.int64)

        return tell

    def tester(self, block: int):
        """A function of a text: its distinct grams that pass."""
        tell = self.teller(block)
        return lambda text: tell([text])[1]


def _bits(grams: DataFrame, slots: int) -> Bits:
    """At most `slots` bits a width come to the driver."""
    at = F.col("gram").bitwiseAND(F.lit(slots - 1)) + 1
    made = grams.groupBy("width", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    return Bits(((r["width"], r["bucket"], r["bits"]) for r in made.collect()), slots)


def _named_grams(block: int):
    """Frames of a needle's number, its width and each of its grams."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            texts, ids = list(pdf["needle"]), pdf["id"].to_numpy()
            widths = np.array([width(t) for t in texts], dtype=np.int32)
            for of, windows in _blocks(texts, block):
                for w in set(widths[of].tolist()):
                    at = np.arange(max(0, len(of) - w + 1))
                    at = at[(of[at] == of[at + w - 1]) & (widths[of[at]] == w)]
                    rows = pd.DataFrame({"id": ids[of[at]], "width": np.int32(w), "gram": windows[w][at].view(np.int64)})
                    yield rows.drop_duplicates()

    return run


def _counted(rows: DataFrame, text: str, bits: Bits, block: int) -> DataFrame:
    """gram, n: the number of texts that hold it, summed up in a batch first."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(frames):
        import pandas as pd

        tell = held.value.teller(block)
        for pdf in frames:
            grams, n = np.unique(tell([t or "" for t in pdf[text]])[1], return_counts=True)
            yield pd.DataFrame({"gram": grams, "n": n})

    return rows.select(text).mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _met(rows: DataFrame, text: str, bits: Bits, block: int) -> DataFrame:
    """_of, gram: the hash of each text with its grams that pass."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(frames):
        import pandas as pd

        tell = held.value.teller(block)
        for pdf in frames:
            owner, grams = tell([t or "" for t in pdf[text]])
            yield pd.DataFrame({"_of": pdf["_of"].to_numpy()[owner], "gram": grams})

    return rows.select(F.xxhash64(text).alias("_of"), text).mapInPandas(run, "_of long, gram long")


def contained(rows: DataFrame, needles: DataFrame, text: str, needle: str, slots: int = SLOTS, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """Rows of `rows` with `needle`: once for each distinct needle that is a substring of `text`.

    A needle of which some gram is in no text is done with after the count. Candidates carry hashes and numbers, and copies of
    a text share theirs. Texts stay where they are if candidates take at most `held` bytes, counted as they are written; else texts are shuffled, once.
    """
    scratch, rows = Scratch(rows.sparkSession, "containment"), rows.drop(needle)
    names = needles.where(F.col(needle) != "").select(F.col(needle).alias("needle")).distinct().withColumn("id", F.monotonically_increasing_id())
    names = scratch.cut(names, "names")
    wanted = scratch.cut(names.mapInPandas(_named_grams(block), "id long, width int, gram long"), "grams")
    counts = _counted(rows, text, _bits(wanted, slots), block)
    n = F.coalesce("n", F.lit(0))
    keys = wanted.join(counts, "gram", "left").groupBy("id", "width").agg(F.min_by("gram", F.struct(n, "gram")).alias("gram"), F.min(n).alias("least"))
    keys = scratch.cut(keys.where("least > 0").drop("least"), "keys")
    found = _met(rows, text, _bits(keys, slots), block).join(keys, "gram").select("_of", "id").distinct()
    found = found.join(names, "id").select("_of", F.col("needle").alias("_needle"))
    size = F.coalesce(F.sum(F.octet_length("_needle") + 64), F.lit(0))
    found, seen = scratch.observed(found, "found", size=size)
    found = F.broadcast(found) if seen["size"] <= held else found.hint("merge")
    at = F.xxhash64(text) == F.col("_of")
    out = rows.join(found, at & F.contains(F.col(text), F.col("_needle")))
    return out.select(*rows.columns, F.col("_needle").alias(needle))


def _words(text: str, shortest: int, most: int):
    """Frames of distinct words, of as many texts as have about `most` of them, and how often one text in some has each: that says which are common, and nothing else."""

    def run(frames):
        import pandas as pd

        def told():
            kept = [(w.decode(), n) for w, n in held.items() if len(w) >= shortest]
            held.clear()
            return pd.DataFrame(kept, columns=["word", "n"])

        held: Counter[bytes] = Counter()
        for pdf in frames:
            for k, t in enumerate(pdf[text]):
                words = (t or b"").translate(_WORDS).split()
                dict.update(held, dict.fromkeys(filterfalse(held.__contains__, words), 0))
                if k % COUNTED == 0:
                    held.update(set(words))
            if len(held) >= most:
                yield told()
        yield told()

    return run


def _in_words(scratch: Scratch, rows: DataFrame, names: DataFrame, text: str, needle: str, shortest: int, slots: int, block: int, held: int, common: int) -> DataFrame:
    """Needles of word characters: a text holds one if one of its words does. Texts are read twice: for the words that there are, and for those that hold a needle."""
    said = F.col(text).cast("binary").alias(text)
    words = rows.select(said).mapInPandas(_words(text, shortest, WORDS), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.cut(words, "words")
    hits, n = scratch.counted(contained(words.select("word"), names, "word", "needle", slots, block, held).withColumnRenamed("needle", needle), "hits")
    telling = hits.select("word").distinct()
    no = words.join(telling, "word", "left_anti").orderBy(F.desc("n"), "word").limit(common)
    slots = min(BITS, max(slots, 1 << (16 * n).bit_length()))
    bits = _bits(telling.select(F.lit(0).alias("width"), F.crc32("word").alias("gram")), slots)
    known = rows.sparkSession.sparkContext.broadcast((frozenset(r[0].encode() for r in no.collect()), bits))
    rest = [c for c in rows.columns if c != text]
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), *rest, said)

    def run(frames):
        import pandas as pd

        no, bits = known.value
        on, mask = bits.packed.tobytes(), bits.slots - 1
        for pdf in frames:
            owner, found = [], []
            for k, t in enumerate(pdf[text]):
                for w in set(filterfalse(no.__contains__, (t or b"").translate(_WORDS).split())):
                    h = zlib.crc32(w) & mask
                    if on[h >> 3] >> (h & 7) & 1:
                        owner.append(k)
                        found.append(w.decode())
            yield pdf.drop(columns=text).iloc[owner].assign(_word=pd.Series(found, dtype=object).to_numpy())

    schema = rows.drop(text).withColumn("_word", F.lit("")).schema
    return rows.mapInPandas(run, schema).join(hits.withColumnRenamed("word", "_word"), "_word").select("_row", *rest, needle).distinct().drop("_row")


def mentioned(rows: DataFrame, needles: DataFrame, text: str, needle: str, slots: int = SLOTS, block: int = BLOCK, held: int = HELD, common: int = COMMON) -> DataFrame:
    """What `contained` gives but for `text`, which is not shuffled for needles of word characters only."""
    scratch, rows = Scratch(rows.sparkSession, "mentions"), rows.drop(needle)
    names = needles.where(F.col(needle) != "").select(F.col(needle).alias("needle")).distinct()
    worded = F.col("needle").rlike(rf"\A[{WORD}]+\z") & (F.length("needle") >= SHORTEST)
    names, seen = scratch.observed(names.withColumn("worded", worded), "names", by="worded", shortest=F.min(F.when(F.col("worded"), F.length("needle"))), others=F.count_if(~F.col("worded")))
    out = None
    if seen["shortest"]:
        out = _in_words(scratch, rows, names.where("worded").select("needle"), text, needle, seen["shortest"], slots, block, held, common)
    if seen["others"] or out is None:
        others = names.where("NOT worded").select(F.col("needle").alias(needle))
        others = contained(rows, others, text, needle, slots, block, held).drop(text)
        out = others if out is None else out.unionByName(others)
    return out
