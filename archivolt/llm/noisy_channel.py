"""A noisy channel for disguised words: leetspeak, spacing and repetition make a character lattice, which a Viterbi search under
a character language model decodes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
#: The model's symbols: a blank, LETTERS from 1 on, and one each for other letters, digits and marks.
BLANK, OTHER, DIGIT, MARK = 0, len(LETTERS) + 1, len(LETTERS) + 2, len(LETTERS) + 3
SYMBOLS = len(LETTERS) + 4
#: The letters that a digit or mark may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "il", "+": "t", "(": "c", "{": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
#: What the channel asks, in nats: for a letter written as another sign, a digit or mark in a word that is one, a mark put in
#: (twice that for marks that may be letters), a blank put in, a blank between single characters that is one, as most there
#: aren't, and a letter repeated.
SUBSTITUTED, KEPT, INSERTED, SPACED, PARTED, REPEATED = 0.3, 1.0, 2.5, 0.0, 1.0, 0.5
#: Characters of a token or spaced run that are decoded at once; longer ones are decoded in pieces.
PIECE = 128
#: Shares of the trigram, bigram, unigram and uniform models.
SHARES = (0.75, 0.18, 0.06, 0.01)


@cache
def symbol_table() -> np.ndarray:
    """The symbol of each code point of the basic plane; letters beyond it are OTHER."""
    out = np.full(1 << 16, MARK, np.int32)
    for c in range(1 << 16):
        x = chr(c)
        if x.isspace():
            out[c] = BLANK
        elif x.isdigit():
            out[c] = DIGIT
        elif x.isalpha():
            out[c] = LETTERS.find(x.lower()) + 1 if len(x.lower()) == 1 and x.lower() in LETTERS else OTHER
    return out


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 1 << 16, symbol_table()[np.minimum(points, 0xFFFF)], OTHER)


def gram_counts(docs: DataFrame) -> np.ndarray:
    """How often each three symbols stand in a row, in all whole texts (a blank before and after each): SYMBOLS cubed counts,
    of which the driver gets those that aren't zero. One row per gram and partition is exchanged."""
    size = SYMBOLS**3

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.text:
                for at in range(0, max(len(text), 1), 1 << 20):  # two symbols go before each piece
                    s = symbols(text[max(at - 2, 0) : at + (1 << 20)])
                    s = np.concatenate([[BLANK] * 2 if not at else [], s, [BLANK] if at + (1 << 20) >= len(text) else []]).astype(np.int64)
                    gram, n = np.unique((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], return_counts=True)
                    total[gram] += n
        found = np.flatnonzero(total)
        yield pd.DataFrame({"gram": found, "n": total[found]})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text")).mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[rows.gram.to_numpy(np.int64)] = rows.n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log P(symbol | the two before it), interpolated, as float32; [before, last, symbol]."""
    ratio = lambda n: n / np.maximum(n.sum(-1, keepdims=True), 1)
    bigram, unigram = counts.sum(0), counts.sum((0, 1))
    mixed = SHARES[0] * ratio(counts) + SHARES[1] * ratio(bigram) + SHARES[2] * ratio(unigram) + SHARES[3] / SYMBOLS
    return -np.log(mixed).astype(np.float32)


#: A way to read one place of the lattice: symbols, text, cost.
Option = tuple[tuple[int, ...], str, float]


def lattice(token: str) -> list[list[Option]]:
    """For each place of a token or spaced run the ways to read it. Letters stand for themselves; one that stands three
    times or more for one or two; a digit or mark for itself, for its LEET letters or, a mark, for nothing; a blank between
    single characters for itself or for nothing."""
    out: list[list[Option]] = []
    at = 0
    while at < len(token):
        c = token[at].lower()
        many = 1
        while at + many < len(token) and token[at + many].lower() == c:
            many += 1
        s = int(symbols(c)[0]) if len(c) == 1 else OTHER
        if s == BLANK:
            out.append([((BLANK,), " ", PARTED), ((), "", SPACED)])
            at += 1
            continue
        letters = [(LETTERS.index(x) + 1, x) for x in LEET.get(c, "")]
        if s in (DIGIT, MARK):
            own = [((s,) * many, c * many, KEPT)]
            own += [((k,) * n, x * n, SUBSTITUTED + REPEATED * (many > n)) for k, x in letters for n in {1, min(many, 2)}]
            if s == MARK:
                own.append(((), "", INSERTED * (2 if letters else 1)))
            out.append(own)
        elif many >= 3:
            out.append([((s,) * n, c * n, REPEATED) for n in (1, 2)])
        else:
            out.append([((s,) * many, c * many, 0.0)])
        at += many
    return out


def viterbi(places: list[list[Option]], costs: np.ndarray) -> str:
    """The cheapest reading of a lattice between two blanks; of equal ones the first listed."""
    best = {(BLANK, BLANK): (0.0, None)}
    for options in places:
        new: dict = {}
        for (a, b), (cost, path) in best.items():
            for row, text, extra in options:
                x, y, total = a, b, cost + extra
                for s in row:
                    total += costs[x, y, s]
                    x, y = y, s
                found = new.get((x, y))
                if found is None or total < found[0]:
                    new[x, y] = (total, (path, text))
        best = new
    path = min(best.items(), key=lambda kv: kv[1][0] + costs[kv[0][0], kv[0][1], BLANK])[1][1]
    parts = []
    while path:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts))


#: Four single characters or more with single blanks between them.
SPACED_RUN = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")
_EDGE = ".,;:?\"'()[]{}«»“”…"
_MARKS = re.compile(r"([^\w\s])\1{2,}$|!!$")
_LETTER = re.compile(r"[^\W\d_]")
_THRICE = re.compile(r"([^\W\d_])\1\1", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")


class Decoder:
    """Restores tokens, and remembers those it has met, up to a bound in characters."""

    def __init__(self, costs: np.ndarray, remembered: int = 8_000_000):
        self.costs, self.remembered, self.held = costs, remembered, 0
        self.known: dict[str, str] = {}

    def decode(self, run: str) -> str:
        return "".join(viterbi(lattice(run[k : k + PIECE]), self.costs) for k in range(0, len(run), PIECE))

    def token(self, token: str) -> str:
        """The restored form of a token without blanks: lower case, edge marks gone, decoded if it has letters and anything else."""
        found = self.known.get(token)
        if found is not None:
            return found
        core = token.strip(_EDGE)
        while core and (m := _MARKS.search(core)):
            core = core[: m.start()].strip(_EDGE)
        if core.isalpha() and not _THRICE.search(core):
            out = core.lower()
        else:
            out = self.decode(core) if _LETTER.search(core) else core
        if len(token) <= PIECE:
            if self.held > self.remembered:
                self.known.clear()
                self.held = 0
            self.known[token] = out
            self.held += len(token) + len(out)
        return out

    def spaced(self, text: str) -> str:
        """The text with its runs of single characters decoded."""
        return SPACED_RUN.sub(lambda m: self.decode(m.group()), text)

    def restore(self, text: str) -> str:
        """The whole text with all tokens restored, one blank between them, line feeds kept."""
        return "\n".join(" ".join(map(self.token, line.split())) for line in self.spaced(text).split("\n"))
