"""Problem 5: variant spellings of organisation names.

Distinct names are brought to tokens (case, accents, legal forms, wrappers, known short forms and nicknames aside; order
does not matter). MinHash bands over padded q-grams of the tokens give candidates; bands and rows are chosen from the
collision curve for the wanted recall. Candidates are verified by a symmetric Monge-Elkan similarity whose inner measure
knows abbreviations, initials and single typing errors and scores unlike tokens 0, so names that merely share words fall
apart. Verified links are clustered by star clustering: in rounds, every free name that outranks its free neighbours
(by links, then rows, then hash) becomes a centre and takes them as satellites. Chains of links therefore never merge
two stars.

Results: null and blank names are linked to nothing; names equal after normalisation are one node, so a name carried by a
third of all rows costs one; ties between centres go to the higher similarity, then the smaller hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.llm import vec
from sievework.llm.canonical import is_short_for, plain, typed
from sievework.llm.skew import blocked, hot_keys, may_pair
from sievework.session import written

Q = 3
#: A word is common from so many names, and from this share of all names, upwards.
COMMON_LEAST, COMMON_SHARE = 20, 0.005
#: Likeness of a name and its short form without common words at the end.
SHORT_FORM = 0.92
#: Legal forms and group words, which don't tell organisations apart (fixed values).
LEGAL = set(
    "ltd limited llc inc incorporated corp corporation gmbh plc sa ag co company group grp holdings holding hldgs hldg kg bv nv oy ab srl sarl spa llp lp pty pvt the".split()
)
#: Short forms of words in names of organisations (fixed values).
SHORT = {
    "intl": "international", "int": "international", "mfg": "manufacturing", "sw": "software", "tech": "technologies", "labs": "laboratories", "lab": "laboratories",
    "sys": "systems", "ins": "insurance", "mgmt": "management", "svcs": "services", "svc": "services", "assoc": "associates", "assocs": "associates",
    "bros": "brothers", "univ": "university", "hosp": "hospital", "natl": "national", "logist": "logistics", "dept": "department", "engg": "engineering", "technology": "technologies",
}
#: Nicknames by given name (fixed values).
NICKNAMES = {
    "robert": "bob bobby rob robbie bert robt", "richard": "dick rick ricky rich richie richd", "william": "bill billy will willy wm", "edward": "ed eddie ted teddy ned edw",
    "elizabeth": "liz lizzie beth betty eliza libby eliz", "margaret": "maggie meg peggy marge margie marg", "katherine": "kate kathy katie kat kitty", "patricia": "pat patty tricia trish",
    "alexander": "alex sandy xander", "charles": "charlie chuck chas", "james": "jim jimmy jamie jas", "john": "jack johnny jon", "thomas": "tom tommy thos", "michael": "mike mick mickey",
    "joseph": "joe joey jos", "theodore": "theo ted teddy", "anthony": "tony", "andrew": "andy drew", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy",
    "henry": "harry hal hank", "samuel": "sam sammy saml", "benjamin": "ben benny benj", "susan": "sue susie", "deborah": "deb debbie", "jennifer": "jen jenny", "barbara": "barb babs",
    "dorothy": "dot dottie", "frances": "fran", "francis": "frank", "frederick": "fred freddie", "george": "georgie geo", "gregory": "greg", "helen": "nell", "lawrence": "larry",
    "matthew": "matt", "nicholas": "nick", "peter": "pete", "philip": "phil", "rebecca": "becky", "ronald": "ron", "stephen": "steve", "steven": "steve", "victoria": "vicky",
}
FULL: dict[str, set[str]] = {}
for _name, _nicks in NICKNAMES.items():
    for _nick in _nicks.split():
        FULL.setdefault(_nick, set()).add(_name)


def tokens(name: str) -> list[str]:
    """Words of a name in their order, without what doesn't tell organisations apart."""
    text = re.sub(r"\b(?:[A-Za-z]\.\s?){2,}", lambda m: re.sub(r"[.\s]", "", m.group()) + " ", name)  # L.L.C., S. A.
    text = re.sub(r"\bG\.?m\.?b\.?H\b\.?", "gmbh", text, flags=re.I)
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text)  # CaslonoSoftware
    found = re.findall(r"[a-z0-9]+", plain(text).replace("'", ""))
    kept = [w for w in found if w not in LEGAL and w not in ("and", "y", "und", "et")] or found
    words = [SHORT.get(w, w) for w in kept]
    return [next(iter(FULL[w])) if len(FULL.get(w, ())) == 1 else w for w in words]


def inner(a: str, b: str) -> float:
    """Likeness of two tokens, 0 when they are different words."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if b in FULL.get(a, ()) or a in FULL.get(b, ()):
        return 0.95
    if len(a) == 1:
        return 0.95 if b[0] == a else 0.0
    if len(a) >= 3 and len(b) - len(a) >= 2 and is_short_for(a, b) and len(b) > 6 and 2 * len(a) < 1.9 * len(b):
        return 0.93 if not b.startswith(a) or len(a) <= 5 else 0.0
    if len(a) >= 4 and len(b) - len(a) <= 1 and typed(a, b) <= 1:
        return 1 - 1 / len(b)
    return 0.0


def likeness(a: list[str], b: list[str], common: frozenset[str] | set[str] = frozenset()) -> float:
    """Symmetric Monge-Elkan similarity; 0 if any token of either side has no counterpart. Names whose letters run
    together the same way (a blank too many or too few) are compared as one word. A name of two words or more that is
    the beginning of the other, but for words of ``common`` at its end, and isn't all of such words itself, is a short form of it."""
    if not a or not b:
        return 0.0
    x, y = "".join(a), "".join(b)
    if x == y:
        return 1.0
    if abs(len(x) - len(y)) <= 1 and min(len(x), len(y)) >= 8 and len(a) != len(b) and typed(x, y) <= 1:
        return 1 - 1 / len(x)
    short, full = (a, b) if len(a) < len(b) else (b, a)
    if 2 <= len(short) < len(full) and full[: len(short)] == short and common.issuperset(full[len(short) :]) and not common.issuperset(short):
        return SHORT_FORM
    sides = []
    for these, those in ((a, b), (b, a)):
        best = [max(inner(t, u) for u in those) for t in these]
        if min(best) == 0:
            return 0.0
        sides.append(sum(best) / len(best))
    if len(a) != len(b) or sum(1 for t in a if len(t) > 1 and t not in b) > 2:
        return 0.0
    return min(sides)


def bands_for(similarity: float, recall: float, rows: int = 3) -> int:
    """Bands that reach ``recall`` at ``similarity``: from 1 - (1 - s**rows)**bands."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def grams(words: list[str]) -> list[int]:
    out = set()
    for w in words:
        padded = f"^^{w}$" if len(w) > 1 else f"^^{w}"
        out.update(padded[i : i + Q] for i in range(len(padded) - Q + 1))
    return [hash_of(g) for g in out]


def one_deletion(word: str) -> set[str]:
    """The word and, if it may be mistyped (four letters or more beside a longer form), what is left without one letter: two
    words that one typing error tells apart share an entry."""
    return {word} | ({word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) >= 4 else set())


def typing_keys(words: list[str], common: set[str]) -> set[str]:
    """Keys that names share for certain if (w) a word that isn't common is the same on both sides but for
    one typing error, or (n) the whole names are, but for one typing error in one of their words, or (j) whatever their blanks, but for one
    typing error."""
    n, keys = len(words), {f"j {short}" for short in one_deletion("".join(words))}
    for i, word in enumerate(words):
        rest = " ".join(sorted(words[:i] + words[i + 1 :]))
        for short in one_deletion(word):
            keys.add(f"n {n} {rest}/{short}")
            if word not in common:
                keys.add(f"w {n} {short}")
    return keys


def hash_of(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def nodes(names: DataFrame) -> DataFrame:
    """From (name, rows): (name, rows, node, words). ``node`` is a hash of the normalised name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [tokens(n) for n in batch.column(0).to_pylist()]
            ids = [hash_of(" ".join(w)) - (1 << 63) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.string()))], ["name", "rows", "node", "words"])

    return names.mapInArrow(run, "name string, rows long, node long, words array<string>").where(F.size("words") > 0)


def common_words(keys: DataFrame, least: int, share: float) -> frozenset[str]:
    """Words that many of the names hold. Each stands in ``share`` of them, so there are at most 1 / ``share`` such words for
    every word that a name has on average, whatever the number of names."""
    least = max(least, share * keys.count())
    counts = keys.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count()
    return frozenset(r["w"] for r in counts.where(F.col("count") > least).select("w").collect())


def links(
    keys: DataFrame, least_gram_similarity: float = 0.35, recall: float = 0.97, least: float = 0.9, rows: int = 2, hot: int = 2_000, common_least: int = COMMON_LEAST, common_share: float = COMMON_SHARE
) -> DataFrame:
    """Verified links (a, b, score), in both directions, between the nodes (node, words) of ``keys``.

    Words that more than ``common_least`` names and more than ``common_share`` of all names hold (trades, "sons",
    "partners") say little and would put all names of a trade into one bucket: names are banded by their other words, if
    they have any. Where what is left is short, one typing error leaves too few equal grams: such pairs meet by
    ``typing_keys`` for certain. ``hot`` decides only where rows go. README gives the recall measured against all pairs."""
    bands = bands_for(least_gram_similarity, recall, rows)
    common = common_words(keys, common_least, common_share)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = vec.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            sets = [grams([t for t in w if t not in common] or w) for w in batch.column(1).to_pylist()]
            off = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
            values = np.array([x for s in sets for x in s], np.uint64)
            low = vec.minhashes(values, off, bands * rows, seed=5).reshape(len(sets), bands, rows).astype(np.uint64)
            key = np.zeros((len(sets), bands), np.uint64)
            for r in range(rows):
                key = vec.mix(key + low[:, :, r] + salt)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), vec.list_array(vec.int64(key.reshape(-1)), np.arange(len(sets) + 1) * bands, pa.int64())], ["node", "g"]
            )

    signed = keys.select("node", "words").mapInArrow(banded, "node long, g array<long>")
    keyed = signed.select(F.explode("g").alias("g"), "node")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [[hash_of(k) - (1 << 63) for k in typing_keys(w, common)] for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["node", "g"])

    typed_keys = keys.select("node", "words").mapInArrow(spelled, "node long, g array<long>")
    keyed = keyed.unionByName(typed_keys.select(F.explode("g").alias("g"), "node"))
    keyed = written(keyed, "name-keys")
    keyed = blocked(keyed, "g", "node", hot_keys(keyed, "g", "node", hot))
    pairs = keyed.alias("x").join(keyed.alias("y"), "g").where((F.col("x.node") < F.col("y.node")) & may_pair(F.col("x.side"), F.col("y.side"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    words = keys.select("node", "words")
    both = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, wa, wb = (batch.column(i).to_pylist() for i in range(4))
            score = [likeness(x, y, common) for x, y in zip(wa, wb)]
            keep = [i for i, s in enumerate(score) if s >= least]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep] + [b[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep] + [a[i] for i in keep], pa.int64()), pa.array([score[i] for i in keep] * 2, pa.float64())],
                ["a", "b", "score"],
            )

    return both.select("a", "b", "wa", "wb").mapInArrow(verify, "a long, b long, score double")


def stars(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, centre) of every node of ``keys`` (node, rows): star clustering in rounds until no node is free."""
    degree = edges.groupBy("a").agg(F.count("*").alias("degree")).withColumnRenamed("a", "node")
    rank = F.struct(F.coalesce("degree", F.lit(0)).alias("d"), F.col("rows").alias("n"), F.col("node").alias("h"))
    ranked = keys.join(degree, "node", "left").select("node", rank.alias("rank"))
    linked = edges.join(ranked.select(F.col("node").alias("a"), F.col("rank").alias("ra")), "a").join(ranked.select(F.col("node").alias("b"), F.col("rank").alias("rb")), "b")
    free = written(linked, "star-edges")
    done = keys.join(free.select(F.col("a").alias("node")).distinct(), "node", "left_anti").select("node", F.col("node").alias("centre"))
    parts = [done]
    while free.limit(1).count():
        top = free.groupBy("a").agg(F.first("ra").alias("ra"), F.max("rb").alias("best")).where(F.col("ra") > F.col("best")).select(F.col("a").alias("c"))
        near = free.join(top, free.a == top.c).select(F.col("b").alias("node"), F.col("a").alias("centre"), "score")
        best = F.row_number().over(W.partitionBy("node").orderBy(F.desc("score"), "centre"))
        taken = near.withColumn("i", best).where("i = 1").select("node", "centre").unionByName(top.select(F.col("c").alias("node"), F.col("c").alias("centre")))
        taken = written(taken, "star-round")
        parts.append(taken)
        gone = taken.select("node")
        rest = free.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
        before = free.select("a").distinct().join(gone.withColumnRenamed("node", "a"), "a", "left_anti")
        free = written(rest, "star-edges")
        alone = before.join(free.select("a").distinct(), "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("centre"))
        parts.append(alone)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def linked_rows(records: DataFrame, companies: DataFrame) -> DataFrame:
    """(tbl, row_id, company_id) of all rows of ``records`` (tbl, row_id, name) whose star holds rows of ``companies``
    (company_id, name), with the least company_id there, unless the name is exactly that row's."""
    named = records.where(F.trim("name") != "").groupBy("name").agg(F.count("*").alias("rows"))
    named = written(nodes(named), "names")
    # The number of parts is given, since the Python steps that follow cost more than their bytes tell.
    parts = records.sparkSession.sparkContext.defaultParallelism
    keys = written(named.groupBy("node").agg(F.sum("rows").alias("rows"), F.first("words").alias("words")).repartition(parts, "node"), "name-nodes")
    star = written(stars(keys.select("node", "rows"), written(links(keys), "name-links")), "stars")
    spelled = named.select("name", "node").join(star, "node").select("name", "centre")
    listed = companies.where(F.trim("name") != "").select("company_id", "name")
    least = listed.join(spelled, "name").groupBy("centre").agg(F.min(F.struct("company_id", "name")).alias("row"))
    target = spelled.join(least, "centre").where(F.col("name") != F.col("row.name")).select("name", F.col("row.company_id").alias("company_id"))
    return records.join(target, "name").select("tbl", "row_id", "company_id")
