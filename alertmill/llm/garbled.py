"""Text decoded with the wrong encoding: round-trip repair under a garbling cost learnt from the whole corpus."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread

#: Letter pairs rarer than one in so many of the corpus count as unknown. The table of the others grows with the corpus
#: and has at most so many rows (12 bytes each); up to so many pairs in all, every pair that occurs is in it.
MOST_PAIRS = 1 << 24
#: A repair must lower the cost of a token by this many nats, and by the share below of its cost.
LEAST_DROP, LEAST_SHARE = 7.0, 0.12
#: Layers that one step of the search looks ahead; it is a step's reach, steps go on while the cost drops.
AHEAD = 3
CAPITALS = 4.0
#: Where the intended encoding accepts nearly any bytes, the mean cost of a pair must drop by this many nats too.
LEAST_MEAN = 0.7
#: A reading most of whose pairs stand nowhere in the corpus is an accident of the bytes.
LEAST_KNOWN = 0.35
#: ... but not if so many characters decode strictly as UTF-8: an inner layer may be new to the corpus.
SURE_CHARACTERS = 4
#: Nats for each place where the letters cannot stand together in writing, whatever the corpus holds: a source that is
#: garbled throughout makes its own letter pairs cheap.
ODD_PLACE = 8.0
#: Copies of one text that count for the letter pairs, and the share of suspect words from which a text counts for none.
COPIES, SUSPECT = 64, 0.25
_SPACE = re.compile(r"([ \t\r\n]+)")
_WORD = re.compile(r"[!-\x7f]*[^\x00-\x7f][^ ]*")
_HIGH = re.compile(r"[^\x00-\x7f]+")
_EAST = re.compile("[\u2e80-\u9fff]")
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")
_REFERENCE = re.compile(r"&#(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));?")
#: A run without white space that holds a character beyond ASCII or a numeric reference.
_TOKEN = re.compile(r"[^ \t\r\n]*?(?:[^\x00-\x7f]|&#)[^ \t\r\n]*")

#: Fixed values: (encoding the text was wrongly decoded with, encodings it may really be in). "sloppy" is cp1252 whose
#: undefined bytes are the control characters of the same number, so it covers latin-1 as well.
WRONG_TO_TRUE: dict[str, tuple[str, ...]] = {
    "sloppy": ("utf-8", "cp1251", "koi8_r", "gb18030", "cp932", "mac_roman", "cp1250", "iso8859_2", "big5", "euc_jp", "cp437", "cp850", "cp866"),
    "latin_1": ("utf-8", "cp1251", "koi8_r", "gb18030", "cp932", "mac_roman", "cp1250", "iso8859_2", "big5", "euc_jp", "cp437", "cp850", "cp866"),
    "mac_roman": ("utf-8", "sloppy", "cp1251", "gb18030", "cp932"),
    "cp437": ("utf-8", "sloppy", "cp1251", "cp866"),
    "cp850": ("utf-8", "sloppy"),
    "cp1250": ("utf-8", "sloppy", "iso8859_2"),
    "iso8859_2": ("utf-8", "sloppy", "cp1250"),
    "cp1251": ("utf-8", "koi8_r", "cp866", "sloppy", "gb18030", "cp932"),
    "koi8_r": ("utf-8", "cp1251", "cp866"),
    "cp866": ("utf-8", "cp1251", "koi8_r"),
    "gbk": ("utf-8", "cp932", "big5", "cp1251", "sloppy"),
    "big5": ("utf-8", "gb18030"),
    "cp932": ("utf-8", "gb18030", "sloppy"),
    "cp949": ("utf-8", "gb18030", "cp932"),
}
#: Single-byte readings of UTF-8 whose high runs are repaired one by one inside a token.
_RUN_WISE = ("sloppy", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866")
#: Lead and continuation byte of UTF-8 in some single-byte reading, or a character that only damage leaves.
_SLOPPY = "".join(chr(b) if b < 128 else bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256))
_SLOPPY_MAP = {ord(c): b for b, c in enumerate(_SLOPPY)}


def _odd_places() -> re.Pattern[str]:
    high = [chr(c) for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7)]
    small, large = "".join(c for c in high if c.islower()), "".join(c for c in high if c.isupper())
    west = "À-ÖØ-öø-ÿŒœŠšŽžŸ"
    cyrillic = [chr(c) for c in range(0x400, 0x460)]
    small_c, large_c = "".join(c for c in cyrillic if c.islower()), "".join(c for c in cyrillic if c.isupper())
    greek = "\u0391-\u03a9\u03b1-\u03c9"
    latin, other = f"A-Za-z{small}{large}", f"{small_c}{large_c}{greek}"
    # not quotes, dashes and dots, which may join two words
    sign = "\x80-\x9f\xa1-\xa9\xab-\xac\xae-\xb9\xbb-\xbf\xd7\xf7\u0192\u02c6-\u02dd\u201a\u201e\u2020-\u2022\u2030\u2039-\u203a\u2044\u2070-\u209f\u20ac\u2122\u2200-\u22ff\u2310-\u2321\u2500-\u25ff\ue000-\uf8ff"
    return re.compile(
        f"(?<=[a-z{small}])[{large}]|(?<=[{small}])[A-Z]|(?<=[{small_c}])[{large_c}]"  # a capital inside a word
        f"|(?<=[{west}]{{3}})[{west}]"  # no western word has four such letters in a row
        "|(?<=[a-z])[\u4e00-\u9fff]|(?<=[\u4e00-\u9fff])[a-z]"
        f"|(?<=[{latin}])[{other}]|(?<=[{other}])[{latin}]"  # two scripts in a word
        f"|(?<=[{latin}{other}])(?<![lL](?=·))[{sign}‘’“”–—…\xa0\xad]*[{sign}][{sign}‘’“”–—…\xa0\xad]*(?=[{latin}{other}])"  # signs inside a word
        f"|[ÂÃâã][{sign}]|[ÂÃ][\xa0\xad]"  # first bytes of UTF-8 read alone
    )


_ODD = _odd_places()
LOST = "�"
#: Reasons: the text was restored, in whole or in part; or replacement characters show that letters are lost for good.
ROUND_TRIP, LOST_LETTERS = "round_trip", "lost_letters"


def encode(text: str, name: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _SLOPPY_MAP)[0] if name == "sloppy" else text.encode(name)
    except UnicodeEncodeError:
        return None


def decode(raw: bytes, name: str) -> str | None:
    try:
        return codecs.charmap_decode(raw, "strict", _SLOPPY)[0] if name == "sloppy" else raw.decode(name)
    except UnicodeDecodeError:
        return None


def odd_cost(text: str) -> float:
    return ODD_PLACE * len(_ODD.findall(text))


def evidence(text: str) -> str:
    """What a text adds to the letter pairs: suspect words, those with odd places, leave a space, so none vouches for itself.

    Where they are common, all words beyond ASCII are left out.
    """
    text = _SPACE.sub(" ", resolve(text))
    if text.isascii():
        return text
    words = _WORD.findall(text)
    odd = {w for w in words if _ODD.search(w)}
    if not odd:
        return text
    if sum(w in odd for w in words) >= SUSPECT * len(words):
        return _WORD.sub(" ", text)
    return _WORD.sub(lambda m: " " if m.group() in odd else m.group(), text)


def _character(m: re.Match) -> str:
    n = int(m[1], 16) if m[1] else int(m[2])
    if 0x80 <= n < 0xA0:
        return _SLOPPY[n]  # as browsers read these numbers
    return chr(n) if 0 < n < 0xD800 or 0xDFFF < n < 0x110000 else m[0]


def resolve(text: str) -> str:
    """The text with its numeric character references as characters; numbers that are no character stay."""
    return _REFERENCE.sub(_character, text) if "&#" in text else text


def letter_pairs(text: str) -> np.ndarray:
    """The adjacent character pairs of the text between two spaces, each as one number; digits count as one character."""
    cp = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cp[(cp > 48) & (cp < 58)] = 48
    return (cp[:-1] << 21) | cp[1:]


class PairTable(NamedTuple):
    """Letter pairs in order with their counts, and the count of all pairs, rare ones included."""

    pairs: np.ndarray
    counts: np.ndarray
    total: int


@lru_cache(1 << 17)
def _has(name: str, c: str) -> bool:
    return encode(c, name) is not None


#: The characters beyond ASCII of each single-byte encoding.
_CAN = {n: re.compile("[" + re.escape("".join(c for b in range(128, 256) if (c := decode(bytes([b]), n)))) + "]") for n in _RUN_WISE}


def stretches(text: str, name: str) -> list[str]:
    """The text cut where characters that the encoding has meet those that it lacks, if it is of a script without spaces."""
    if not _EAST.search(text) or (name in _CAN and not _CAN[name].search(text)) or not any(c > "\x7f" and _has(name, c) for c in text):
        return [text]
    return ["".join(g) for _, g in groupby(text, lambda c: c < "\x80" or _has(name, c))]


class Repairer:
    """Token by token; cost of a token is the sum over its character pairs of -log of the pair's share of the corpus."""

    def __init__(self, table: PairTable):
        total = float(max(table.total, 1))
        self.pairs = table.pairs
        self.price = (np.log(total + 1) - np.log(table.counts + 0.3)).astype(np.float32)
        self.unknown = float(np.log(min(total + 1, MOST_PAIRS)) - np.log(0.3))
        self.memo: dict[str, str] = {}

    def _price(self, text: str) -> tuple[float, int, int]:
        """(cost, pairs that the table has, pairs)."""
        pairs = letter_pairs(text)
        n = len(pairs)
        if not len(self.pairs):
            return self.unknown * n, 0, n
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        hit = self.pairs[at] == pairs
        known = int(np.count_nonzero(hit))
        return float(self.price[at[hit]].sum()) + self.unknown * (n - known), known, n

    def measure(self, text: str) -> tuple[float, float]:
        """(cost, share of the pairs that the corpus has at all).

        Capitals are rarer than the words they spell: a token costs no more than its small letters and a mark-up.
        """
        cost, known, n = self._price(text)
        small = text.lower()
        if small != text:
            cost = min(cost, self._price(small)[0] + CAPITALS)
        return cost, known / n

    def _candidates(self, token: str) -> Iterator[tuple[str, bool, bool]]:
        """Readings of the token, whether strict decoding alone is weak evidence for them, and whether it is proof."""
        one_run = _HIGH.fullmatch(token)
        for wrong, trues in WRONG_TO_TRUE.items():
            raw = encode(token, wrong)
            if wrong in _RUN_WISE and (raw is None or not one_run):  # a single run is read below
                yield _HIGH.sub(lambda m: self._run(m.group(), wrong), token), False, False
            if raw is not None:
                # two-byte characters of the East Asian encodings are often two bytes of UTF-8 too, seldom three
                least = "\x7f" if wrong in _RUN_WISE else "\u07ff"
                for true in trues:
                    out = decode(raw, true)
                    if out is not None:
                        yield out, true != "utf-8", true == "utf-8" and sum(c > least for c in out) >= SURE_CHARACTERS
            elif len(parts := stretches(token, wrong)) > 1:
                # correct text that the encoding lacks touches a garbled passage
                for true in trues:
                    out = "".join(p if p.isascii() or (raw := encode(p, wrong)) is None else decode(raw, true) or p for p in parts)
                    if out != token:
                        yield out, true != "utf-8", False
        # the case of a garbled text was changed afterwards
        yield _HIGH.sub(lambda m: self._cased(m.group(), str.upper, str.lower) if "µ" not in m.group() else m.group(), token), False, False
        yield _HIGH.sub(lambda m: self._cased(m.group(), str.lower, str.upper), token), False, False

    @classmethod
    def _cased(cls, run: str, there: Callable[[str], str], back: Callable[[str], str]) -> str:
        moved = there(run)
        out = cls._run(moved, "sloppy")
        return run if out == moved else back(out)

    @staticmethod
    def _run(run: str, wrong: str) -> str:
        raw = encode(run, wrong)
        if raw is None:
            return "".join(decode(encode(p, wrong) or b"", "utf-8") or p for p in stretches(run, wrong))
        return decode(raw, "utf-8") or run

    def token(self, token: str) -> str:
        """The token restored, or as it was. Nested layers are undone one after the other while the cost drops."""
        known = self.memo.get(token)
        if known is not None:
            return known
        now, met = token, set()
        while now not in met:
            met.add(now)
            now = self._search(now, AHEAD, {})[0]
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[token] = now
        return now

    def _search(self, now: str, ahead: int, seen: dict[tuple[str, int], tuple[str, float]]) -> tuple[str, float]:
        """(cheapest reading within so many layers, its cost with odd places).

        seen holds the answers of the texts met so far. Inner layers are looked into where a reading is shorter, as each
        layer of UTF-8 makes it.
        """
        if (now, ahead) in seen:
            return seen[now, ahead]
        price = self.measure(now)[0] + odd_cost(now)
        best, best_price, proven, deeper = now, price, False, False
        tried: set[str] = {now}
        controls = _CONTROL.search(now)
        for option, weak, proof in self._candidates(now):
            inner = not weak and ahead > 1 and len(option) < len(now)
            fresh = not controls and bool(_CONTROL.search(option))  # control characters may only be those of an inner layer
            if (option in tried and not proof) or (fresh and not inner):
                continue
            tried.add(option)
            p, known = self.measure(option)
            o = odd_cost(option)
            end, p = option, p + o
            # an inner layer still has odd places or is new to the corpus: it counts as what it leads to
            if inner and (o or fresh or known < LEAST_KNOWN):
                end, p = self._search(option, ahead - 1, seen)
                if fresh and _CONTROL.search(end):
                    continue
            # fewer characters are cheaper in sum: where any bytes decode, the cost of each pair must drop as well
            likely = known >= LEAST_KNOWN or end != option or (not weak and sum(c > "\x7f" for c in option) >= SURE_CHARACTERS)
            if proof and (not proven or p < best_price):
                best, best_price, proven, deeper = end, p, True, end != option
            elif not proven and likely and p < best_price and not (weak and p / (len(option) + 1) > price / (len(now) + 1) - LEAST_MEAN):
                best, best_price, deeper = end, p, end != option
        got = now, price
        if best != now and (proven or price - best_price >= max(LEAST_DROP, LEAST_SHARE * price)):
            got = (best, best_price) if deeper or ahead == 1 else self._search(best, ahead - 1, seen)
        seen[now, ahead] = got
        return got

    def text(self, text: str | None) -> tuple[str | None, str | None]:
        """(why it is garbled or null, its text as far as it can be restored). Numeric references are judged as what they stand for."""
        if not text or (text.isascii() and "&#" not in text):
            return None, text
        fixed = _TOKEN.sub(lambda m: self._part(m.group()), text)
        return ROUND_TRIP if fixed != text else LOST_LETTERS if lost_characters(resolve(text)) else None, fixed

    def _part(self, part: str) -> str:
        plain = resolve(part)
        if plain.isascii():
            return part
        fixed = self.token(plain) if plain is part else "".join(p if p.isascii() else self.token(p) for p in _SPACE.split(plain))
        return part if fixed == plain else fixed  # references that are right stay as they are written


def lost_characters(text: str) -> bool:
    """A replacement character stands where a letter, digit or sign was."""
    return LOST in text


def pair_counts(docs: DataFrame, text: str = "text") -> PairTable:
    """How often each letter pair occurs, copies damped. The driver gets MOST_PAIRS rows at most, by the share they must have.

    All copies of a text count as COPIES of it at most, whatever share of the rows they are. Only hashes of texts that
    occur twice are joined, so texts stay where they are as long as that list can be broadcast.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0)
        some: dict[int, list[str]] = {}
        size = 0

        def add() -> None:
            nonlocal pairs, counts
            new, weights = [pairs], [counts]
            for n, texts in some.items():
                # texts joined by a space have the pairs that each has between two spaces
                k, c = np.unique(letter_pairs(" ".join(texts)), return_counts=True)
                new.append(k)
                weights.append(c * (min(n, COPIES) / n))
            pairs, where = np.unique(np.concatenate(new), return_inverse=True)
            counts = np.bincount(where, np.concatenate(weights), len(pairs))
            some.clear()

        for b in batches:
            for t, n in zip(b["t"], b["n"]):
                if t:
                    some.setdefault(int(n), []).append(evidence(t))
                    size += len(t)
                if size > 500_000:
                    add()
                    size = 0
        add()
        yield pd.DataFrame({"pair": pairs, "c": counts})

    texts = docs.select(F.col(text).alias("t")).filter("t is not null")
    copied = materialize(texts.groupBy(F.xxhash64("t").alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "copied")
    weighed = texts.withColumn("h", F.xxhash64("t")).join(copied, "h", "left").select("t", F.coalesce("n", F.lit(1)).alias("n"))
    table = materialize(spread(weighed).mapInPandas(count, "pair long, c double").groupBy("pair").agg(F.sum("c").alias("c")), "pairs")
    total = table.agg(F.coalesce(F.sum("c"), F.lit(0.0))).first()[0]
    got = table.filter(F.col("c") >= total / MOST_PAIRS).toPandas().sort_values("pair")
    # whole numbers but for the order of addition
    counts = np.maximum(np.rint(got["c"].to_numpy(float)), 1).astype(np.int64)
    return PairTable(got["pair"].to_numpy(np.int64), np.minimum(counts, 2**31 - 1).astype(np.int32), int(round(total)))


def _repair_batches(table: PairTable, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    fix = Repairer(table)
    for b in batches:
        done = [fix.text(t) for t in b["text"]]
        yield pd.DataFrame({"id": b["id"], "garbled": [d[0] is not None for d in done], "reason": [d[0] for d in done], "restored": [d[1] for d in done]})


def repair(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, garbled, reason, restored) for every record.

    The cost is learnt from all texts, copies damped and suspect words left out: character pairs that the corpus rarely has are
    dear. Places that no writing has, and strict UTF-8, count whatever the corpus holds. A token (a run without
    white space) is re-encoded under each legacy encoding and strictly decoded as the intended one; high runs inside a
    token are tried alone, for texts that are garbled in part. The cheapest reading wins if the cost drops clearly, and
    the search repeats on it, for any number of nested layers, while the cost drops. reason is ``round_trip`` for these;
    a text that only shows replacement characters is garbled too (``lost_letters``), though what they stood for cannot be
    restored. Null and empty texts are not garbled and come back as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pair_counts(docs, text))
    fn = partial(_with_broadcast, shared)
    kind = dict(docs.dtypes)[id_col]
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))).mapInPandas(fn, f"id {kind}, garbled boolean, reason string, restored string")


def _with_broadcast(shared, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    yield from _repair_batches(shared.value, batches)
