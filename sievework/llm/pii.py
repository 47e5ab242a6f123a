"""Problem 3: personal data in free text, by a BiLSTM over tokens with a CRF on top.

A token is a run of letters and digits or a single other sign. What the network knows of one comes from its characters
(convolutions, the largest value of each), its form and, for common words, a vector of its own; as tokens repeat, this is
worked out once for each distinct token of a chunk. The BiLSTM (``pii_train`` fits it in numpy from labelled spans) scores
every token of a sentence with a tag of the BIO scheme over five kinds; the CRF's transitions make whole spans of it. Texts
are cut into sentences, and the network reads every one of them, whatever its form. Pieces that begin or end alike share the
states of the network up to the first difference, which changes no result. Long sentences are read in overlapping windows:
every token takes its scores from the window in which it lies deepest. The CRF scores every sentence as a whole; the path
itself is only looked for where the best one isn't 'outside' throughout. The spans found are then set to whole tokens.

Results: null, empty and blank texts have no findings; whole texts are read; the same string found twice in a row is one
finding; repeated rows have the same findings.
"""

from __future__ import annotations

import io
import os
import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.llm import vec

KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
#: Tag 0 is outside; kind k begins with tag 2k + 1 and goes on with 2k + 2.
TAGS = 1 + 2 * len(KINDS)
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.npz")
#: Longest window, and what neighbouring windows share, in tokens.
WINDOW, OVERLAP = 96, 40
#: Sentences and tokens of one search for best paths, pieces of one run of the network, characters taken together.
BATCH, CELLS, ROWS, POOL = 512, 1 << 18, 1024, 1 << 22
#: Characters around one that a convolution sees, and characters convolved at a time.
REACH, AT_ONCE = 2, 1 << 16
#: Sentences beyond this length have their best path looked for at once.
LONG = 5000

#: Symbols with an own embedding: printable ASCII and letters of Western languages; all else shares three more.
SYMBOLS = "".join(chr(c) for c in range(32, 127)) + "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒłŁśŚżŻźŹćĆńŃęĘąĄšŠžŽčČřŘ’–"
SIZE = len(SYMBOLS) + 4  # padding, other letter, other digit, other

#: Words that suggest personal data in a sentence without capitals or digits (``worth_reading``; fixed values).
CUES = (
    "mr mrs ms miss dr prof mister madam herr frau madame monsieur senor senora dot whatsapp telegram sms phone telephone tel mobile landline email inbox contact attn "
    "recruiter named signed signature cheque payable regards sincerely cc passport ssn nino licence license insurance social"
).split()
#: Words of addresses, which suggest one if a number stands among the four words before or the two after (fixed values).
STREET_CUES = (
    "box street st road rd avenue ave lane ln drive dr court ct row blvd boulevard way place pl square terrace close crescent gardens grove mews passage parade circle parkway alley wharf quay walk hill rise green "
    "rue chemin impasse quai place calle via plaza paseo corso piazza platz flat apt apartment unit suite"
).split()
#: Words that often open a sentence or part of it with a capital before a name of any kind (fixed values).
OPENERS = (
    "a about above after again all along also although an and any are as at because before behind below beside between both but by can could did do does each either even every few for from had has have he her here his how i if in inside into is it its "
    "just last less like many may more most much my near new next no nobody not now of off on once one only or other our out over own people same several she should since so some such than that the their them then there these they this those "
    "through to today under until up upon us very was we were what when where whether which while who why will with within without would yes you your"
).split()
_STREET_ENDS = ("straße", "strasse", "str.", "weg", "platz", "gasse", "allee", "markt")
#: Words whose full stop doesn't end a sentence (fixed values).
ABBREVIATIONS = "mr mrs ms dr prof st ave rd blvd ln dr ct apt no nr p o box inc ltd co corp jr sr tel ext s a".split()


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    out = np.full(0x110000, SIZE - 1, np.uint8)
    alnum = vec.alnum_table()
    out[alnum] = SIZE - 3
    out[vec.category_table(("N",))] = SIZE - 2
    for i, s in enumerate(SYMBOLS):
        out[ord(s)] = i + 1
    for c in (9, 10, 13, 0xA0):
        out[c] = out[32]
    return out


#: Kinds of symbols.
SIGN, SMALL, CAPITAL, DIGIT, BLANK = range(5)


@lru_cache(maxsize=1)
def symbol_kinds() -> np.ndarray:
    """Kind of every symbol."""
    out = np.full(SIZE, SIGN, np.uint8)
    for i, c in enumerate(SYMBOLS):
        out[i + 1] = BLANK if c == " " else CAPITAL if c.isupper() else SMALL if c.isalpha() else DIGIT if c.isdigit() else SIGN
    out[SIZE - 3], out[SIZE - 2] = SMALL, DIGIT
    return out


@lru_cache(maxsize=1)
def small_symbols() -> bytes:
    """Every symbol's small letter, as a table for ``bytes.translate``."""
    low = [SYMBOLS.find(c.lower()) if c.lower() in SYMBOLS else i for i, c in enumerate(SYMBOLS)]
    return bytes([0] + [i + 1 for i in low] + list(range(len(SYMBOLS) + 1, 256)))


#: Forms of a token: a sign; small, Capitalised, one capital, CAPITALS, mixed letters; one to eight digits; digits and letters.
SHAPES = 16


class Tokens:
    """The tokens of a chunk of symbols whose pieces begin at ``start``: ``begin``, ``end``, the number of each one's kind
    (equal symbols, equally with or without a blank before) and, by kind, the place of one token and its features."""

    def __init__(self, symbols: np.ndarray, start: np.ndarray):
        n = len(symbols)
        kind = symbol_kinds()[symbols]
        solid = kind != BLANK
        joined = np.zeros(n + 1, bool)  # with the character before
        inside = solid & (kind != SIGN)
        joined[1:n] = inside[1:] & inside[:-1]
        joined[start] = False
        self.begin = s = np.flatnonzero(solid & ~joined[:-1])
        self.end = e = np.flatnonzero(solid & ~joined[1:]) + 1
        self.symbols = symbols
        spaced = np.zeros(len(s), bool)
        spaced[:] = ~solid[s - 1] | (s == 0)
        at = np.searchsorted(s, start)
        spaced[at[at < len(s)]] = True  # as if a blank stood before every piece
        power, inverse = vec.powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(vec.mix(np.arange(1, SIZE + 1, dtype=np.uint64) * np.uint64(vec.BASE))[symbols] * power, out=total[1:])
        _, place, self.kind = np.unique(vec.mix((total[e] - total[s]) * inverse[s] + spaced), return_index=True, return_inverse=True)
        self.at, self.to = s[place], e[place]
        size = self.to - self.at
        count = lambda which: (lambda c: c[self.to] - c[self.at])(np.concatenate(([0], np.cumsum(kind == which))))
        digits, capitals, letters = count(DIGIT), count(CAPITAL), count(CAPITAL) + count(SMALL)
        first = kind[self.at] == CAPITAL
        form = np.where(capitals == 0, 1, np.where(size == 1, 3, np.where(capitals == size, 4, np.where(first & (capitals == 1), 2, 5))))
        form = np.where(digits == size, 5 + np.minimum(size, 8), np.where(digits > 0, 14 + (kind[self.at] != DIGIT), np.where(letters > 0, form, 0)))
        self.form = form + SHAPES * spaced[place]

    def words(self, known: dict[bytes, int]) -> np.ndarray:
        """Number of each kind's word, 0 for those not known."""
        data = self.symbols.tobytes().translate(small_symbols())
        return np.array([known.get(data[a:b], 0) for a, b in zip(self.at.tolist(), self.to.tolist())], np.int64)

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """Kind and symbols around (2 * REACH + 1; 0 beyond the token) of every character of every kind."""
        size = self.to - self.at
        of = np.repeat(np.arange(len(size)), size)
        i = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out = np.zeros((len(of), 2 * REACH + 1), np.uint8)
        for k in range(-REACH, REACH + 1):
            on = (i + k >= 0) & (i + k < size[of])
            out[on, k + REACH] = self.symbols[(self.at[of] + i + k)[on]]
        return of, out


@lru_cache(maxsize=8)
def _words(which: str) -> np.ndarray:
    text = " ".join({"cues": CUES, "streets": STREET_CUES, "openers": OPENERS, "abbreviations": ABBREVIATIONS}[which])
    _, cps, off, _ = next(vec.chunks(pa.array([text])))
    return np.unique(vec.words(cps, off)[0])


def _capitals() -> np.ndarray:
    return vec.category_table(("Lu", "Lt"))


def sentences(cps: np.ndarray, off: np.ndarray, hashes: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """First characters of the sentences of a chunk, whose words are given by hash, start and end."""
    n = len(cps)
    stop = (cps == 46) | (cps == 33) | (cps == 63)
    ends = np.zeros(n, bool)
    if n > 2:
        blank = (cps[1:-1] == 32) | (cps[1:-1] == 9)
        upper = _capitals()[cps[2:]] | (cps[2:] == 45)
        ends[:-2] = stop[:-2] & blank & upper
    # A full stop after an abbreviation or a single letter doesn't end a sentence.
    short = np.isin(hashes, _words("abbreviations")) | (e - s == 1)
    after = e[short & (e < n)]
    ends[after[cps[after] == 46]] = False
    ends |= (cps == 10) | (cps == 13)
    cut = np.zeros(n + 1, bool)
    cut[1:] = ends
    cut[off] = True
    return np.flatnonzero(cut[:n])


def worth_reading(cps: np.ndarray, off: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the sentences of a chunk whose form suggests personal data. A measure of texts only: the
    operator doesn't choose by it, every sentence is read."""
    n = len(cps)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    hashes, _, s, e = vec.words(cps, off)
    start = sentences(cps, off, hashes, s, e)
    end = np.append(start[1:], n)
    hit = np.zeros(len(start), bool)

    def mark(at: np.ndarray) -> None:
        hit[np.searchsorted(start, at, side="right") - 1] = True

    digits = (cps >= 48) & (cps <= 57)
    # Five digits with nothing but signs of telephone numbers between them.
    at = np.flatnonzero(digits)
    if len(at) >= 5:
        joined = np.isin(cps, [32, 40, 41, 43, 45, 46, 47, 0xA0]) | digits
        holes = np.concatenate(([0], np.cumsum(~joined)))
        close = (holes[at[4:]] == holes[at[:-4]]) & (at[4:] - at[:-4] <= 12)
        mark(at[:-4][close])
    mark(np.flatnonzero(cps == 64))
    # Street names that end a word, and bracketed at signs, are found in the joined string.
    low = text.lower()
    for needle in (*_STREET_ENDS, "(at)", "[at]", "p.o.", "p. o."):
        at = low.find(needle) if len(low) == n else -1
        while at >= 0:
            hit[np.searchsorted(start, at, side="right") - 1] = True
            at = low.find(needle, at + 1)
    if len(s):
        capital = _capitals()[cps[s]]
        number = digits[s]
        of = np.searchsorted(start, s, side="right")
        inner = (s[1:] - e[:-1] <= 3) & (of[1:] == of[:-1])
        opener = np.isin(hashes, _words("openers"))
        initial = (e - s == 1) & capital
        pair = inner & capital[1:] & (capital[:-1] & (~opener[:-1] | initial[:-1]) | number[:-1])
        pair[:-1] |= inner[:-1] & inner[1:] & capital[:-2] & initial[1:-1] & capital[2:] if len(pair) > 1 else False
        mark(s[:-1][pair])
        mark(s[np.isin(hashes, _words("cues"))])
        street, beside = np.isin(hashes, _words("streets")), np.zeros(len(s), bool)
        for gap in (1, 2, 3, 4):
            same = of[gap:] == of[:-gap]
            beside[gap:] |= number[:-gap] & same
            if gap < 3:
                beside[:-gap] |= number[gap:] & same
        mark(s[street & beside])
    keep = hit & (end - start >= 4)
    start, end = start[keep], end[keep]
    return np.searchsorted(off, start, side="right") - 1, start, end


def _groups(which: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """The sentences ``which`` by length, as many at a time as BATCH and CELLS characters, filled up, allow."""
    which = which[np.argsort(length[which], kind="stable")]
    at = 0
    while at < len(which):
        n = min(BATCH, len(which) - at)
        while n > 1 and n * length[which[at + n - 1]] > CELLS:
            n //= 2
        yield which[at : at + n]
        at += n


class Tagger:
    """The trained network."""

    def __init__(self, path: str = WEIGHTS):
        # The package may be inside an archive on the executors, so the file is read through its loader.
        data = open(path, "rb").read() if os.path.exists(path) else pkgutil.get_data(__name__, os.path.basename(path))
        w = np.load(io.BytesIO(data))
        self.hidden = w["wh"].shape[1]
        # With sigmoid(x) = (1 + tanh(x / 2)) / 2, one tanh serves all gates; the states are kept twofold.
        half = np.ones(4 * self.hidden, np.float32)
        half[: 3 * self.hidden] = 0.5
        self.known = {word: i + 1 for i, word in enumerate(w["words"].tolist())}
        # A convolution is a sum of what the symbol at each place gives to it.
        self.convolution = np.einsum("ce,kef->kcf", w["chars"], w["conv"].reshape(2 * REACH + 1, w["chars"].shape[1], -1)).astype(np.float32)
        self.shift, self.word, self.form = w["shift"], w["word"], w["form"]
        self.inputs, self.given = (w["wx"] * half).astype(np.float32), (w["b"] * half).astype(np.float32)
        self.recurrent = (w["wh"] * half * 0.5).astype(np.float32)
        self.out, self.bias = (w["wo"] * 0.5).astype(np.float32), w["bo"].astype(np.float32)
        self.trans, self.first, self.last = w["trans"], w["first"], w["last"]

    def features(self, tokens: Tokens) -> np.ndarray:
        """What the network knows of each kind of token."""
        of, around = tokens.around()
        most = np.full((len(tokens.at), self.shift.shape[0]), -np.inf, np.float32)
        for at in range(0, len(of), AT_ONCE):
            part = around[at : at + AT_ONCE]
            sums = self.convolution[0].take(part[:, 0], axis=0)
            for k in range(1, 2 * REACH + 1):
                sums += self.convolution[k].take(part[:, k], axis=0)
            first = np.flatnonzero(np.diff(of[at : at + AT_ONCE], prepend=-1))
            kind = of[at + first]
            most[kind] = np.maximum(most[kind], np.maximum.reduceat(sums, first, axis=0))
        return np.concatenate([np.tanh(most + self.shift), self.word[tokens.words(self.known)], self.form[tokens.form]], axis=1)

    def states(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, side: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What one direction gives to the emissions of pieces of ``symbols`` (kinds of tokens, rows of ``table``): the place
        of every token's values, and the values (place, tags).

        The state behind a token depends only on what was read before it, so pieces that begin alike (in reading
        direction) share their states up to the first difference; each state is computed once for a block of sorted pieces."""
        data = (symbols if side == 0 else symbols[::-1]).astype(np.int32).tobytes()
        a, b = (start, end) if side == 0 else (len(symbols) - end, len(symbols) - start)
        keys = [data[x:y] for x, y in zip((4 * a).tolist(), (4 * b).tolist())]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        place = np.zeros(len(symbols), np.int32)
        values, base = [], 0
        h = self.hidden
        recurrent, out = self.recurrent[side], self.out[side * h : side * h + h]
        for at in range(0, len(order), ROWS):
            block = order[at : at + ROWS]
            length = end[block] - start[block]
            steps = np.arange(int(length.max()))[:, None]
            live = steps < length  # step, piece
            where = np.where(live, start[block] + steps if side == 0 else end[block] - 1 - steps, 0)
            seen = np.where(live, symbols[where], 0)
            new = np.ones(seen.shape, bool)
            np.not_equal(seen[:, 1:], seen[:, :-1], out=new[:, 1:])
            np.logical_or.accumulate(new, axis=0, out=new)
            new &= live
            number = np.cumsum(new.ravel()).reshape(new.shape) - 1
            place[where[live]] = number[live] + base
            count = new.sum(axis=1)
            first = np.cumsum(count) - count
            step, piece = np.nonzero(new)
            symbol = seen[step, piece]
            before = number[step - 1, piece] - first[step - 1]
            states = np.empty((len(step), h), np.float32)
            hid = cell = np.zeros((1, h), np.float32)
            before[: count[0]] = 0
            most = int(count.max())
            z, given, room = np.empty((most, 4 * h), np.float32), np.empty((most, 4 * h), np.float32), np.empty((most, h), np.float32)
            for f, n in zip(first.tolist(), count.tolist()):
                old = before[f : f + n]
                hid, cell = hid.take(old, axis=0), cell.take(old, axis=0)
                g, x, r = z[:n], given[:n], room[:n]
                np.matmul(hid, recurrent, out=g)
                table.take(symbol[f : f + n], axis=0, out=x, mode="clip")
                g += x
                np.tanh(g, out=g)
                np.multiply(cell, g[:, h : 2 * h], out=r)
                cell += r
                np.multiply(g[:, :h], g[:, 3 * h :], out=r)
                r += g[:, 3 * h :]
                cell += r
                cell *= 0.5
                np.tanh(cell, out=r)
                hid = states[f : f + n]
                np.multiply(g[:, 2 * h : 3 * h], r, out=hid)
                hid += r
            values.append(states @ out)
            base += len(step)
        return place, np.concatenate(values)

    def holds(self, emissions: Iterator[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """Is the best tag sequence of a sentence another than 'outside' throughout? Emissions come step by step (batch,
        tags); scores only, so that the search for the path itself is left to the few sentences that hold something."""
        n, last, rest = len(lengths), self.last[:, None], np.zeros(len(lengths), bool)
        score = calm = None
        both = np.empty((TAGS, TAGS, n), np.float32)
        trans = self.trans[:, :, None]
        for step, e in enumerate(emissions):
            if step:
                np.add(score[:, None, :], trans, out=both)
                score = both.max(axis=0)
                calm = calm + self.trans[0, 0]
            else:
                score, calm = np.repeat(self.first[:, None], n, axis=1), np.repeat(self.first[0], n)
            score += e.T
            calm += e[:, 0]
            done = np.flatnonzero(lengths == step + 1)
            if len(done):
                rest[done] = (score[:, done] + last).max(axis=0) > calm[done] + self.last[0]
        return rest

    def viterbi(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags (batch, time) of padded emissions (time, batch, tags)."""
        t, n, k = emissions.shape
        score = self.first + emissions[0]
        back = np.zeros((t, n, k), np.int8)
        into = np.ascontiguousarray(self.trans.T)
        for step in range(1, t):
            both = score[:, None, :] + into
            best = both.argmax(axis=2)
            new = np.take_along_axis(both, best[:, :, None], 2)[:, :, 0] + emissions[step]
            live = (step < lengths)[:, None]
            back[step] = np.where(live, best, np.arange(k))
            score = np.where(live, new, score)
        tag = (score + self.last).argmax(axis=1)
        path = np.zeros((n, t), np.int8)
        for step in range(t - 1, -1, -1):
            path[:, step] = tag
            tag = back[step][np.arange(n), tag]
        return path

    def tags(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(sentence, tag of each of its characters) of the sentences with any tag but 'outside'."""
        tokens = Tokens(symbols, start)
        first = np.searchsorted(tokens.begin, np.append(start, len(symbols)))
        sentence = np.flatnonzero(first[1:] > first[:-1])
        if not len(sentence):
            return
        begin, stop = first[sentence], first[sentence + 1]
        features = self.features(tokens)
        # Windows that overlap; each token belongs to the window in which it lies deepest.
        more = np.maximum(-(-(stop - begin - WINDOW) // (WINDOW - OVERLAP)), 0)
        of = np.repeat(np.arange(len(begin)), more + 1)
        at = begin[of] + (WINDOW - OVERLAP) * (np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1))
        to = np.minimum(at + WINDOW, stop[of])
        size = to - at
        offset = np.cumsum(size) - size
        slots = np.repeat(at - offset, size) + np.arange(int(size.sum()))
        own = (slots >= np.repeat(np.where(at > begin[of], at + OVERLAP // 2, at), size)) & (slots < np.repeat(np.where(to < stop[of], to - OVERLAP // 2, to), size))
        sides = []
        for side in (0, 1):
            place, values = self.states(tokens.kind[slots], offset, offset + size, side, features @ self.inputs[side] + self.given[side])
            sides.append((place[own], values + self.bias if side else values))
        for group in _groups(np.arange(len(begin)), stop - begin):
            length = (stop - begin)[group]
            steps = np.arange(int(length[-1]))[:, None]
            where = np.where(steps < length, begin[group] + steps, 0)
            at, to = (place[where] for place, _ in sides)
            emissions = lambda which: (sides[0][1].take(a[which], axis=0) + sides[1][1].take(b[which], axis=0) for a, b in zip(at, to))
            found = np.flatnonzero(self.holds(emissions(slice(None)), length)) if len(steps) <= LONG else np.arange(len(group))
            if len(found):
                path = self.viterbi(np.stack(list(emissions(found))), length[found])
                for i, n, tags in zip(group[found].tolist(), length[found].tolist(), path):
                    if tags[:n].any():
                        a = int(start[sentence[i]])
                        yield int(sentence[i]), spread(tags[:n], tokens.begin[begin[i] : stop[i]] - a, tokens.end[begin[i] : stop[i]] - a, int(end[sentence[i]]) - a)


def spread(tags: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Tags of the ``n`` characters of a sentence from those of its tokens; blanks inside a span belong to it."""
    out = np.zeros(n, np.int8)
    for i in np.flatnonzero(tags).tolist():
        t, a, b = int(tags[i]), int(begin[i]), int(end[i])
        if t % 2:
            out[a], out[a + 1 : b] = t, t + 1
        else:
            out[int(end[i - 1]) if i and (tags[i - 1] + 1) // 2 == t // 2 else a : b] = t
    return out


@lru_cache(maxsize=2)
def tagger(path: str = WEIGHTS) -> Tagger:
    return Tagger(path)


def spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the spans of a tag sequence."""
    out = []
    at, kind = -1, -1
    for i, t in enumerate(tags.tolist() + [0]):
        k = (t - 1) // 2 if t else -1
        if at >= 0 and (k != kind or t % 2 == 1):
            out.append((at, i, KINDS[kind]))
            at = -1
        if k >= 0 and at < 0:
            at, kind = i, k
    return out


_TITLE = re.compile(r"^(?:(?:mr|mrs|ms|miss|dr|prof|herr|frau|sir|madam)\b\.?\s+)+", re.I)
#: Signs that may stand inside a token of a kind, beside letters and digits.
_INSIDE = {"EMAIL": ".+-_'@", "PHONE": "+", "ID": "-", "ADDRESS": "'’-", "NAME": "'’-"}


def settled(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """The span set to whole tokens; (0, 0) if what is left has no form of its kind (a name without two words, a number
    without five digits, an e-mail address without an at sign in any writing)."""
    inside = _INSIDE[kind]
    while start > 0 and text[start].isalnum() and (text[start - 1].isalnum() or (text[start - 1] in inside and start > 1 and text[start - 2].isalnum())):
        start -= 1
    while end < len(text) and text[end - 1].isalnum() and (text[end].isalnum() or (text[end] in inside and end + 1 < len(text) and text[end + 1].isalnum())):
        end += 1
    while start < end and not (text[start].isalnum() or (kind == "PHONE" and text[start] in "+(")):
        start += 1
    while end > start and not (text[end - 1].isalnum()):
        end -= 1
    value = text[start:end]
    if kind == "PHONE" and start < end:
        if text[start] != "+" and start > 0 and text[start - 1] in "+(":
            start -= 1
        if text[start] == "(" and ")" not in value:
            start += 1
    if kind == "NAME":
        if m := _TITLE.match(value):
            start += m.end()
        words = [w for w in re.split(r"[\s,.]+", text[start:end]) if w]
        if len(words) < 2 or max(map(len, words)) < 2 or any(c.isdigit() for c in text[start:end]):
            return 0, 0
        if end < len(text) and text[end] == "." and re.search(r"(?:^|[\s,])\w$", text[start:end]):
            end += 1  # an initial at the end keeps its full stop
    if kind == "ADDRESS" and len(re.findall(r"\w+", value)) < 3:
        return 0, 0
    if kind in ("PHONE", "ID") and sum(c.isdigit() for c in value) < 5:
        return 0, 0
    if kind == "EMAIL" and not re.search(r"@|\bat\b", value, re.I):
        return 0, 0
    return (start, end) if end > start else (0, 0)


def found_in(texts: pa.Array) -> list[tuple[int, int, int, str, str]]:
    """(row, start, end, kind, string) of all findings of a string array."""
    model, table, out = tagger(), symbol_table(), []
    for row, cps, off, text in vec.chunks(texts, POOL):
        if not len(cps):
            continue
        hashes, _, s, e = vec.words(cps, off)
        start = sentences(cps, off, hashes, s, e)
        end = np.append(start[1:], len(cps))
        for i, tags in model.tags(table[cps], start, end):
            a0, sentence = int(start[i]), text[start[i] : end[i]]
            r = int(np.searchsorted(off, a0, side="right")) - 1
            for a, b, kind in spans(tags):
                a, b = settled(sentence, a, b, kind)
                if b > a:
                    base = a0 - int(off[r])
                    out.append((row + r, base + a, base + b, kind, sentence[a:b]))
    return sorted(out)


def findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, pii_text, at): every finding of every row, ``at`` being its first character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = found_in(batch.column(1))
            keys = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([f[3] for f in found], pa.string()), pa.array([f[4] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], [key, "kind", "pii_text", "at"])

    return df.select(key, text).mapInArrow(run, f"`{key}` long, kind string, pii_text string, at long")


def masked(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with every finding replaced by its kind in brackets; all other characters stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_row: dict[int, list] = {}
            for row, a, b, kind, _ in found_in(batch.column(1)):
                by_row.setdefault(row, []).append((a, b, kind))
            out = batch.column(1).to_pylist()
            for row, found in by_row.items():
                s = out[row]
                for a, b, kind in sorted(found, reverse=True):
                    s = s[:a] + f"[{kind}]" + s[b:]
                out[row] = s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, text])

    return df.select(key, text).mapInArrow(run, f"`{key}` long, `{text}` string")
