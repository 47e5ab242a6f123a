"""Problem 4: free-entered values mapped to a canonical list.

The reference entries stand in a BK-tree under the Levenshtein distance, a true metric, so the triangle inequality prunes
exactly: a search returns every entry within the threshold (exchanged neighbours count as one edit in the end). Only distinct values are looked
up. Up to ``shard_size`` entries the tree is broadcast whole; a longer list is cut into shards, every distinct value
visits every shard, and the shards' hits are merged by the rules of one tree, so the answers don't depend on the cut.

``places``: the value is parted into city, region and country by its own punctuation; a stated region must be the
entry's. ``titles``: seniority, grade, contract and advertising words are taken off, inverted forms turned round, and
abbreviated words compared as abbreviations of the entry's words.

Results: null and blank values give no row; values without an entry give -1; equally near entries of different rank are
resolved by stated region, then by the lower id; repeated rows each give a row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import written

#: Entries of a reference list in one tree.
SHARD_SIZE = 50_000


def edits(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel (one machine word or big integer per column)."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        x = at.get(c, 0)
        flat = (((x & up) + up) ^ up) | x | down
        more, less = down | (full & ~(flat | up)), up & flat
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = (more << 1) | 1, less << 1
        up, down = (less | (full & ~((x | down) | more))) & full, more & (x | down) & full
    return score


def typed(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: as ``edits``, but exchanging neighbours is one edit. Never above
    ``edits``, never below half of it."""
    n, m = len(a), len(b)
    last: dict[str, int] = {}
    d = [[n + m] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    d[1][1:] = range(m + 1)
    for i in range(1, n + 1):
        seen = 0
        for j in range(1, m + 1):
            p, q = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[p][q] + (i - p - 1) + 1 + (j - q - 1))
        last[a[i - 1]] = i
    return d[n + 1][m + 1]


class BKTree:
    """Words with payloads. The edges hold Levenshtein distances, so the triangle inequality prunes exactly."""

    def __init__(self, entries: dict[str, list]):
        self.payload = entries
        self.root: tuple[str, dict] | None = None
        for word in entries:
            if self.root is None:
                self.root = (word, {})
                continue
            node = self.root
            while True:
                at = edits(word, node[0])
                if at not in node[1]:
                    node[1][at] = (word, {})
                    break
                node = node[1][at]

    def within(self, word: str, most: int) -> list[tuple[int, str]]:
        """Every entry at a typing distance of at most ``most``, nearest first. Such an entry is at most twice as many
        Levenshtein edits away, which bounds the search."""
        if word in self.payload:
            return [(0, word)]
        if most == 0:
            return []
        radius, found, stack = 2 * most, [], [self.root] if self.root else []
        while stack:
            at, children = stack.pop()
            d = edits(word, at)
            if d <= radius and (near := d if d <= 1 else typed(word, at)) <= most:
                found.append((near, at))
            stack.extend(child for edge, child in children.items() if d - radius <= edge <= d + radius)
        return sorted(found)

    def nearest(self, word: str, most: int) -> list[tuple[int, str]]:
        """As ``within`` for the least distance that finds an entry."""
        for m in range(most + 1):
            if found := self.within(word, m):
                return found
        return []


def plain(text: str) -> str:
    """Lower case without accents, one space between words."""
    low = unicodedata.normalize("NFKD", text.replace("ß", "ss")).lower()
    return " ".join("".join(c for c in low if not unicodedata.combining(c)).split())


def allowed(word: str) -> int:
    """Edits that a value of this length may differ by."""
    return 0 if len(word) < 4 else 1 if len(word) < 10 else 2


# ---- places -----------------------------------------------------------------------------------------------------

#: Names of countries by code (fixed values).
COUNTRIES = {
    "us": ("us", "usa", "u.s.", "u.s.a.", "united states", "united states of america", "america"),
    "gb": ("gb", "uk", "u.k.", "united kingdom", "great britain", "england", "scotland", "wales", "britain"),
    "de": ("de", "germany", "deutschland"),
    "fr": ("fr", "france"),
    "es": ("es", "spain", "espana"),
    "in": ("in", "india", "bharat"),
}
#: Short forms of words that begin names of places (fixed values).
PLACE_WORDS = {
    "st": "saint", "ste": "sainte", "mt": "mount", "ft": "fort", "pt": "port", "prt": "port", "lk": "lake",
    "n": "north", "s": "south", "e": "east", "w": "west", "no": "north", "so": "south", "nth": "north", "sth": "south",
}
_AROUND = re.compile(
    r"\((?:hybrid|remote|on-?site|office)[^)]*\)|^\s*(?:remote|hybrid|on-?site)\s*(?:[-–:/,]|in\b)|^\s*(?:greater|downtown|metro(?:politan)?|central|near|in|around|city of)\s+"
    r"|\s*(?:&|and)\s+(?:surroundings|surrounding areas?|vicinity|environs)\b.*$|\s+(?:metropolitan area|metro area|metro|area|city centre|city center)\s*$",
    re.I,
)


def _parts(value: str) -> list[str]:
    """Parts of a place as typed, without what surrounds it."""
    text = plain(value)
    for _ in range(3):
        text = _AROUND.sub(" ", text).strip()
    parts = [p.strip(" .-–") for p in re.split(r"[,/()|;:]|\s[-–—]\s", text)]
    return [" ".join(p.split()) for p in (re.sub(r"\b\d[\d-]*\b", "", p).strip() for p in parts) if p.split()]


def _city(part: str) -> str:
    words = [w.rstrip(".") for w in re.split(r"[\s-]+", part) if w]
    return " ".join([PLACE_WORDS.get(w, w) if i < len(words) - 1 else w for i, w in enumerate(words)])


def _nearest(hits: list[tuple]) -> list[tuple]:
    return [h for h in hits if h[0] == hits[0][0]] if hits else []


class Places:
    """Reference cities with region and country. ``find`` asks its own trees; with a list in shards, each shard gives the
    ``hits`` of whatever ``find`` might ask, and ``decide`` runs on the hits of all shards, so the answer is the same
    however the list is cut."""

    COUNTRY = {name: code for code, names in COUNTRIES.items() for name in names}

    def __init__(self, rows: list[tuple[int, str, str, str, str]]):
        cities: dict[str, list] = {}
        regions: dict[str, list] = {}
        for place, city, region, code, country in rows:
            cities.setdefault(_city(plain(city or "")), []).append([int(place), plain(code or ""), plain(country or "")])
            for name in (region, code):
                if name and (short := plain(code or region)) not in regions.setdefault(plain(name), []):
                    regions[plain(name)].append(short)
        self.trees = {"city": BKTree(cities), "region": BKTree({r: c for r, c in regions.items() if len(r) > 3})}
        self.exact = {"city": cities, "region": regions}

    def near(self, kind: str, word: str, most: int) -> list[tuple]:
        """(distance, entry, payload) within ``most``, nearest first; an entry equal to ``word`` alone if there is one."""
        if word in self.exact[kind]:
            return [(0, word, self.exact[kind][word])]
        return [(d, e, self.exact[kind][e]) for d, e in self.trees[kind].within(word, most)] if most else []

    def find(self, value: str) -> tuple[int, int]:
        return self.decide(value, self.near)

    def hits(self, value: str) -> list[tuple]:
        """(kind, word, distance, entry, payload) of all that ``decide`` might ask about ``value``."""
        parts = _parts(value)
        heads = [h for p in parts for h in p.rpartition(" ")[::2] if h]
        asked = {("region", p, 2) for p in (*parts, *heads)} | {("city", w, max(1, allowed(w))) for w in map(_city, (*parts, *heads))}
        return [(kind, word, *hit) for kind, word, most in sorted(asked) for hit in self.near(kind, word, most)]

    @classmethod
    def merged(cls, value: str, hits: list[list]) -> tuple[int, int]:
        """The answer from the hits of all shards."""
        found: dict[tuple, dict] = {}
        for kind, word, d, entry, payload in hits:
            one = found.setdefault((kind, word), {}).setdefault(entry, (d, entry, []))
            one[2].extend(p for p in payload if p not in one[2])

        def near(kind: str, word: str, most: int) -> list[tuple]:
            every = sorted((h for h in found.get((kind, word), {}).values() if h[0] <= most), key=lambda h: h[:2])
            return every[:1] if every and every[0][0] == 0 else every

        return cls.decide(value, near)

    @classmethod
    def decide(cls, value: str, near: Callable[[str, str, int], list[tuple]]) -> tuple[int, int]:
        """(distance, place id), or (-, -1)."""
        named = lambda p: min(hit[0][2]) if (hit := near("region", p, 0)) else None

        def mistyped(part: str) -> str | None:
            close = near("region", part, 1 if len(part) < 8 else 2) if len(part) > 4 and part[0].isalpha() else []
            return min(close[0][2]) if close and not near("city", _city(part), 0) else None

        region = country = None
        cities: list[str] = []
        for p in _parts(value):
            if p in cls.COUNTRY and named(p) is None:
                country = cls.COUNTRY[p]
            elif (code := named(p)) is not None:
                region = code
            else:
                cities.append(p)
        if len(cities) > 1 and region is None:  # a region with a typing error beside the city
            for p in cities[1:] + cities[:1]:
                if not near("city", _city(p), 1) and (r := mistyped(p)):
                    region = r
                    cities.remove(p)
                    break
        for p in cities:
            tries = [(p, region, country)]
            head, _, tail = p.rpartition(" ")
            if head and region is None and named(tail) is not None:  # "City RC" without a comma
                tries.insert(0, (head, named(tail), country))
            elif head and country is None and tail in cls.COUNTRY:
                tries.insert(0, (head, region, cls.COUNTRY[tail]))
            for name, where, land in tries:
                word = _city(name)
                found = [(d, len(places), pid) for d, _, places in _nearest(near("city", word, allowed(word))) for pid, code, nation in places if (where is None or code == where) and (land is None or nation == land)]
                if found:
                    d, _, pid = min(found)
                    return d, pid
        return 99, -1


# ---- titles -----------------------------------------------------------------------------------------------------

#: Words about seniority, grade, contract and place of work that don't change a title (fixed values).
GRADE_WORDS = set(
    "senior sr junior jr lead trainee principal intern internship graduate entry mid staff apprentice experienced "
    "i ii iii iv v 1 2 3 4 5 contract contractor permanent temporary temp freelance full part time fulltime parttime "
    "remote hybrid onsite m f d w x mfd wmd mwd".split()
)
_ADVERT = re.compile(
    r"^\s*(?:urgent(?:ly)?(?: hiring)?|new|now hiring|hiring now|hiring|wanted|we are hiring|hot job|apply now|immediate start|top job)\s*[!:–—-]+\s*"
    r"|#\s*\d+|\(.*?\)|\b[mwfdx](?:\s*/\s*[mwfdx]){1,2}\b|\s*[|–—].*$|\s+-\s+(?:remote|contract|hybrid|on-?site|permanent|temporary|full.?time|part.?time|night.*|day.*|weekend.*|freelance|immediate.*|apply.*|urgent.*)\s*$",
    re.I,
)


#: Short forms that aren't beginnings or skeletons of the word (fixed values).
TITLE_WORDS = {"biz": "business", "bus": "business", "maths": "mathematics", "math": "mathematics", "sw": "software", "hw": "hardware"}


def is_short_for(short: str, word: str) -> bool:
    """``short`` begins like ``word`` and its letters come in the same order."""
    if len(short) < 2 or short[0] != word[0] or len(short) >= len(word):
        return False
    rest = iter(word)
    return all(c in rest for c in short)


class Titles:
    """Reference titles."""

    def __init__(self, rows: list[tuple[int, str]]):
        entries: dict[str, list] = {}
        for title, name in rows:
            entries.setdefault(" ".join(self.tokens(name or "")), []).append(int(title))
        self.tree = BKTree(entries)
        self.entries = [(k.split(), min(v)) for k, v in entries.items() if k]
        self.known: dict[str, tuple[int, int]] = {}
        self.ends: dict[str, list] = {}
        for words, title in self.entries:
            for w in {words[0][0], words[-1][0]}:
                self.ends.setdefault(w, []).append((words, title))

    @staticmethod
    def tokens(text: str) -> list[str]:
        text = re.sub(r"\b(?:[A-Za-z]\.){2,}", lambda m: m.group().replace(".", ""), text)  # H.R.
        text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text)  # InfoSec
        return [TITLE_WORDS.get(w, w) for w in re.findall(r"[a-z0-9]+", plain(text).replace("'", "").replace("\u2019", ""))]

    def _aligned(self, got: list[str], words: list[str]) -> int | None:
        """Cost of reading ``got`` as the title ``words`` with abbreviations, initials and typing errors."""
        if not got and not words:
            return 0
        if not got or not words:
            return None
        best: int | None = None
        t, w = got[0], words[0]
        step = None
        if t == w:
            step = 0
        elif is_short_for(t, w):
            step = 1 if len(t) > 2 else 3
        elif len(t) > 3 and abs(len(t) - len(w)) < 3 and typed(t, w) <= allowed(t):
            step = 2
        if step is not None and (rest := self._aligned(got[1:], words[1:])) is not None:
            best = step + rest
        for n in range(2, min(len(t), len(words)) + 1):
            if len(t) == n and all(t[i] == words[i][0] for i in range(n)) and (rest := self._aligned(got[1:], words[n:])) is not None:
                best = min(best if best is not None else 99, 1 + rest)
        return best

    def hits(self, value: str) -> list[tuple]:
        return [self.find(value)]

    @staticmethod
    def merged(value: str, hits: list[list]) -> tuple[int, int]:
        """The answer from the answers of all shards: the nearest entry, then the lowest id."""
        return min((d, i) for d, i in hits if i >= 0) if any(i >= 0 for _, i in hits) else (99, -1)

    def find(self, value: str) -> tuple[float, int]:
        """(distance, title id), or (-, -1). Forms that come first beat equally near ones that come later."""
        text = value
        for _ in range(3):
            text = _ADVERT.sub(" ", text).strip()
        text = re.sub(r"(?:[\s,]+(?:[ivIV]{1,3}|\d))+\s*$", "", text)
        turned = re.sub(r"^([^,]+?)\s*,\s*(.+)$", r"\2 \1", text)
        forms = []
        for form in (turned, text):
            full = self.tokens(form)
            cut = list(full)
            while cut and cut[0] in GRADE_WORDS:
                cut = cut[1:]
            while cut and (cut[-1] in GRADE_WORDS or cut[-1].isdigit()):
                cut = cut[:-1]
            inner = [w for w in cut if w not in ("senior", "sr", "junior", "jr", "trainee", "lead")]
            for words in (full, cut, inner):
                if words and words not in forms:
                    forms.append(words)
        for i, words in enumerate(forms):
            if hit := self.tree.payload.get(" ".join(words)):
                return i / 100, min(hit)
        return min((self._near(" ".join(words)) for words in forms), default=(99, -1))

    def _near(self, name: str) -> tuple[int, int]:
        if name not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[name] = self._search(name)
        return self.known[name]

    def _search(self, name: str) -> tuple[int, int]:
        if found := self.tree.nearest(name, allowed(name)):
            return min((d, min(self.tree.payload[entry])) for d, entry in found)
        words, best = name.split(), (99, -1)
        for entry, title in {id(e): e for w in {words[0][0], words[-1][0]} for e in self.ends.get(w, [])}.values():
            if (cost := self._aligned(words, entry)) is not None:
                best = min(best, (10 + cost, title))
        return best


def mapped(df: DataFrame, key: str, column: str, entries: DataFrame, build: Callable[[list[tuple]], object], shard_size: int = SHARD_SIZE, block: int = 100_000) -> DataFrame:
    """(``key``, ref_id) of every row of ``df`` with a non-blank ``column``. ``entries`` has the id first; ``build`` makes a
    matcher from its rows, with ``find(value) -> (distance, id)``, ``hits(value)`` and ``merged(value, hits of all shards)``.

    A list of at most ``shard_size`` entries is broadcast. A longer one never leaves the executors: it is cut into shards,
    the distinct values into blocks of about ``block``, and every block meets every shard in a task of its own; the shards'
    hits of a value are merged."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(column).alias("v")).where(F.trim("v") != "")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    values = rows.select("v").distinct().repartition(parts, "v")  # by number, as the search costs more than the bytes tell
    size = entries.count()
    if size <= shard_size:
        shared = spark.sparkContext.broadcast([tuple(r) for r in entries.orderBy(entries.columns[0]).collect()])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = build(shared.value).find
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([find(v)[1] for v in batch.column(0).to_pylist()], pa.int64())], ["v", "ref_id"])

        winners = values.mapInArrow(look, "v string, ref_id long")
    else:
        import json

        shards = -(-size // shard_size)
        values = written(values, "values")
        blocks = -(-values.count() // block)
        cut = entries.withColumn("_shard", F.pmod(F.xxhash64(entries.columns[0]), F.lit(shards))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))))
        met = values.withColumn("_block", F.pmod(F.xxhash64("v"), F.lit(max(1, blocks))).cast("int")).withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        names = entries.columns

        def search(left, right):
            import pandas as pd

            matcher = build([tuple(None if x is None or x != x else x for x in r) for r in right.sort_values(names[0])[names].itertuples(index=False)])
            return pd.DataFrame({"v": left["v"], "h": [json.dumps(matcher.hits(v)) for v in left["v"]]})

        found = met.groupBy("_shard", "_block").cogroup(cut.groupBy("_shard", "_block")).applyInPandas(search, "v string, h string")

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [build.merged(v, [x for h in hs for x in json.loads(h)])[1] for v, hs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64())], ["v", "ref_id"])

        winners = found.groupBy("v").agg(F.collect_list("h").alias("h")).mapInArrow(merge, "v string, ref_id long")  # one text per shard
    return rows.join(winners, "v").select(F.col("k").alias(key), "ref_id")
