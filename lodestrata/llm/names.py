"""Spellings of one person or group, linked.

Spellings are folded to keys (case, accents, order of words, honorifics and
quoted nicknames aside). Keys become vectors of character n-grams weighted by
rarity; a sparse self-join over the rarest grams of each vector, as far down as
a pair at or above the cosine threshold can first meet, yields all similar
pairs. Each is then checked word by word: typos, initials, cut words
and joined words agree; two words left over on both sides agree if they do so
beside many different family names (nicknames, translated words, learned from
the data). Checked links are grouped by average linkage on their cosines.

No number of partners is capped: in place of a top n the threshold decides,
since a name may have any number of spellings.

Defined results: null or empty spellings, and such without letters, have no
partner; equal strings count once; ties in linkage go to the smaller key.
Components of more than IN_TASK links are linked by joins, with the same outcome.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut_lineage, spread

#: Length of grams, least cosine of a candidate, least average cosine within a group, links of a component that one task links (more are linked by joins).
GRAM, COSINE, LINKAGE, IN_TASK = 4, 0.4, 0.14, 50_000
#: Family names beside which two words must stand for each other, the share of the rarer word's occurrences, and how few
#: other words a word stands beside to be called rare.
SUPPORT, SUPPORT_SHARE, RARE = 2, 0.25, 3

#: Keys of one gram that one task joins with the others of the gram; more are dealt over several tasks.
DEALT = 2_000

# Honorifics and joining words that tell no one apart.
HONORIFICS = frozenset("dr mr mrs ms sir dj mc don dona doña maestro mestre lady prof sr sra the thee los las les de del da do of and y e su seu".split())

_QUOTED = re.compile(r"[\"“”„«»][^\"“”„«»]*[\"“”„«»]")
_SPLIT = re.compile(r"[^\w]+|_")


def words_of(spelling: str) -> list[str]:
    """Folded words in their order."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", _QUOTED.sub(" ", spelling)) if not unicodedata.combining(c))
    return [w for w in _SPLIT.split(bare.casefold().replace("'", "").replace("’", "")) if w]


def key_of(spelling: str) -> str:
    words = words_of(spelling)
    telling = [w for w in words if w not in HONORIFICS or len(w) == 1 and len(words) > 1]
    return " ".join(sorted(telling or words))


def _near(a: str, b: str) -> bool:
    """At most one slip, two in long words: a letter more, less or other, or two exchanged."""
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 4:
        return False
    return slips(a, b, 2) <= (2 if min(len(a), len(b)) >= 8 else 1)


def slips(a: str, b: str, most: int) -> int:
    """Edit distance with exchanged neighbours, or more than `most`."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def _agree(a: str, b: str) -> bool:
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    if len(short) <= 4 and long.startswith(short) and len(long) > len(short):
        return True
    return _near(a, b)


def _initials(one: list[str], two: list[str]) -> bool:
    """Whether the one word on one side is made of the first letters of the words on the other."""
    return len(one) == 1 and len(two) > 1 and sorted(one[0]) == sorted(w[0] for w in two)


def _short_form(u: str, v: str) -> bool:
    """Whether the shorter word stands inside the longer one or ends like it."""
    short, long = sorted((u, v), key=len)
    return 3 <= len(short) <= 6 < len(long) + 1 and len(long) > len(short) and (short in long or short[-4:] == long[-4:])


def compare(a: str, b: str) -> tuple[str, str, str, str]:
    """What two keys are to each other: yes, no or open, with the words left over and the family name."""
    left, right = a.split(" "), b.split(" ")
    family = ""
    for x in sorted(left, key=len, reverse=True):
        if len(x) < 4:
            break
        match = next((y for y in right if x == y), None) or next((y for y in sorted(right, key=len, reverse=True) if len(y) > 4 and _near(x, y)), None)
        if match and (len(x) > 5 or len(left) == 1 or len(right) == 1):
            if not family or len(x) > len(family):
                family = family or x
            left = left[: left.index(x)] + left[left.index(x) + 1 :]
            right = right[: right.index(match)] + right[right.index(match) + 1 :]
    if not family:
        return "no", "", "", ""
    for x in sorted(left, key=len, reverse=True):
        match = next((y for y in right if _agree(x, y)), None)
        if match:
            left.remove(x)
            right.remove(match)
    for one, two in ((left, right), (right, left)):
        # Words joined: big band, bigband; and letters for several words.
        for x in list(one):
            parts = [y for y in two if y in x]
            if len(parts) > 1 and sum(map(len, parts)) == len(x):
                one.remove(x)
                for y in parts:
                    two.remove(y)
    if not left or not right or _initials(left, right) or _initials(right, left):
        return "yes", "", "", family
    left, right = ([w for w in words if len(w) > 1] or words for words in (left, right))
    u, v = sorted((" ".join(sorted(left)), " ".join(sorted(right))))
    if len(u) == 1 or len(v) == 1:
        return "no", "", "", ""
    return ("likely" if _short_form(u, v) else "open"), u, v, family


_CHECKED = "a bigint, b bigint, cosine double, verdict string, u string, v string, family string"


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [compare(x, y) for x, y in zip(batch["key_a"], batch["key_b"])]
        out = batch[["a", "b", "cosine"]].copy()
        for i, name in enumerate(("verdict", "u", "v", "family")):
            out[name] = [f[i] for f in found]
        yield out[out["verdict"] != "no"]


def cuts(word: str) -> list[str]:
    """The word and all it can become by losing one letter: words a slip apart share one of them."""
    return list(dict.fromkeys([word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]))


def _cut_series(series: pd.Series) -> pd.Series:
    return series.map(lambda w: cuts(w) if w is not None else None)


def cut_column(column: str) -> Column:
    return F.pandas_udf(_cut_series, "array<string>")(column)


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """word_a, word_b: words (column word) that are equal, a slip apart, or two in places that one lost letter on each side mends."""
    a = left.select(F.col("word").alias("word_a"), F.explode(cut_column("word")).alias("cut"))
    b = right.select(F.col("word").alias("word_b"), F.explode(cut_column("word")).alias("cut"))
    return a.join(b, "cut").select("word_a", "word_b").distinct().where((F.col("word_a") == F.col("word_b")) | (F.levenshtein("word_a", "word_b") <= 2))


def _vectors(keys: DataFrame) -> DataFrame:
    """id, grams, weights, rest: n-grams of every key from rare to common, weighted by rarity, of length one, and the squared length left from each gram on."""
    padded = F.transform(F.split("key", " "), lambda w: F.concat(F.lit("#"), w, F.lit("#")))
    cut = F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(w) - (GRAM - 1), F.lit(1))), lambda i: F.substr(w, i, F.lit(GRAM))))))
    grams = keys.select("id", F.explode(cut).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("df"))
    total = float(keys.count())
    weighed = grams.join(counts, "gram").select("id", "df", "gram", F.log(1 + F.lit(total) / F.col("df")).alias("w"))
    vectors = weighed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "w"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    vectors = vectors.withColumn("norm", norm)
    vectors = vectors.select("id", F.transform("v", lambda x: x["gram"]).alias("grams"), F.transform("v", lambda x: x["w"] / F.col("norm")).alias("weights"))
    spent = F.transform("weights", lambda w, i: F.aggregate(F.slice("weights", 1, i), F.lit(0.0), lambda s, x: s + x * x))
    return vectors.withColumn("rest", F.transform(spent, lambda s: 1 - s))


def meeting_keys(vectors: DataFrame) -> DataFrame:
    """a, b: pairs of vectors that may have a cosine of at least COSINE, all such among them.

    All vectors order their grams alike. What two of them have in common begins
    at their first common gram, so their cosine is at most the product of the
    lengths left from there on; where that is too little they needn't meet.
    """
    least = COSINE * COSINE - 1e-9
    held = vectors.select("id", F.explode(F.arrays_zip(F.col("grams").alias("gram"), "rest")).alias("g")).select("id", "g.gram", "g.rest").where(F.col("rest") >= least)
    parts = held.groupBy("gram").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts")).where("parts > 0")
    held = cut_lineage(held.join(parts, "gram"))
    left = held.select("gram", F.col("id").alias("a"), F.col("rest").alias("rest_a"), F.pmod("id", F.col("parts").cast("bigint")).cast("int").alias("part"))
    right = held.select("gram", F.col("id").alias("b"), F.col("rest").alias("rest_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return spread(left, "gram", "part").join(spread(right, "gram", "part"), ["gram", "part"]).where((F.col("a") < F.col("b")) & (F.col("rest_a") * F.col("rest_b") >= least)).select("a", "b").distinct()


def similar_keys(keys: DataFrame) -> DataFrame:
    """a, b, key_a, key_b, cosine of all pairs of keys (columns id, key) with a cosine of at least COSINE."""
    vectors = cut_lineage(_vectors(keys).join(keys, "id"))
    left = vectors.select(F.col("id").alias("a"), F.col("key").alias("key_a"), F.arrays_zip(F.col("grams").alias("g"), F.col("weights").alias("w")).alias("x"))
    right = vectors.select(F.col("id").alias("b"), F.col("key").alias("key_b"), F.col("grams").alias("grams_b"), F.col("weights").alias("weights_b"))
    dot = F.aggregate(
        "x", F.lit(0.0), lambda s, g: s + g["w"] * F.coalesce(F.get("weights_b", (F.array_position("grams_b", g["g"]) - 1).cast("int")), F.lit(0.0))
    )
    met = meeting_keys(vectors).join(left, "a").join(right, "b").select("a", "b", "key_a", "key_b", dot.alias("cosine"))
    return met.where(F.col("cosine") >= COSINE)


def checked_links(keys: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """a, b, cosine of the similar pairs that hold word by word. `known`: key_a, key_b said to be the same by the data themselves."""
    checked = cut_lineage(spread(similar_keys(keys)).mapInPandas(_check, _CHECKED))
    split = keys.select("id", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    counts = split.groupBy("word").agg(F.count("*").alias("df"))
    # With how many other words a word stands: many for a given name, few for a family name.
    beside = keys.select(F.array_distinct(F.split("key", " ")).alias("w")).select(F.explode("w").alias("word"), "w").select("word", F.explode("w").alias("other"))
    degrees = beside.where("word <> other and length(other) > 3").groupBy("word").agg(F.countDistinct("other").alias("degree"))
    words = cut_lineage(counts.join(degrees, "word", "left").na.fill(0, ["degree"]))
    open_ = checked.where("verdict <> 'yes'")
    differing = open_.select("u", "v").distinct()

    def about(side: str) -> DataFrame:
        of = differing.select(side).distinct().select(side, F.explode(F.split(side, " ")).alias("word")).where("length(word) > 1")
        return of.join(words, "word", "left").groupBy(side).agg(F.min("df").alias(f"df_{side}"), F.max("degree").alias(f"degree_{side}"))

    judged = open_.join(differing.join(about("u"), "u").join(about("v"), "v"), ["u", "v"])
    judged = judged.join(words.select(F.col("word").alias("family"), F.col("degree").alias("degree_family")), "family", "left")
    # The shared word is a family name if it stands with fewer others than the differing words do, and isn't the short part.
    is_family = (F.coalesce("degree_family", F.lit(0)) <= F.greatest("degree_u", "degree_v")) & (F.length("family") > F.least(F.length("u"), F.length("v")))
    judged = cut_lineage(judged.withColumn("is_family", is_family))
    support = judged.where("is_family").groupBy("u", "v").agg(F.countDistinct("family").alias("support"))
    judged = judged.join(support, ["u", "v"], "left")
    if known is not None:
        said = known.mapInPandas(_said, "u string, v string").distinct().withColumn("said", F.lit(True))
        judged = judged.join(said, ["u", "v"], "left")
    else:
        judged = judged.withColumn("said", F.lit(None).cast("boolean"))
    learned = (F.col("support") >= SUPPORT) & (F.col("support") >= SUPPORT_SHARE * F.least("df_u", "df_v"))
    # A word hardly seen elsewhere can't be told to be another name; it follows the family name.
    rare = F.least("degree_u", "degree_v") <= RARE
    held = judged.where(F.coalesce("said", F.lit(False)) | learned | F.col("is_family") & (rare | (F.col("verdict") == "likely")))
    return checked.where("verdict = 'yes'").select("a", "b", "cosine").unionByName(held.select("a", "b", "cosine")).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _said(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [compare(x, y) for x, y in zip(batch["key_a"], batch["key_b"])]
        yield pd.DataFrame([f[1:3] for f in found if f[0] in ("open", "likely")], columns=["u", "v"], dtype=str)


def average_linkage(links: Iterable[tuple[int, int, float]], least: float = LINKAGE) -> dict[int, int]:
    """node -> class of one component: the two groups with the greatest mean similarity are joined until none reaches `least`.

    Pairs without a link have similarity 0. The class is the least node of its
    group; of equal means the pair with the smaller nodes comes first.
    """
    sums: dict[int, dict[int, float]] = {}
    for a, b, w in links:
        sums.setdefault(a, {})[b] = w
        sums.setdefault(b, {})[a] = w
    members = {n: [n] for n in sums}
    heap = [(-w, a, b) for a, of in sums.items() for b, w in of.items() if a < b]
    heapq.heapify(heap)
    while heap and -heap[0][0] >= least:
        mean, a, b = heapq.heappop(heap)
        if a not in members or b not in members or sums[a].get(b, 0.0) / (len(members[a]) * len(members[b])) != -mean:
            continue
        members[a] += members.pop(b)
        of, other = sums[a], sums.pop(b)
        del of[b], other[a]
        for c, w in other.items():
            del sums[c][b]
            of[c] = sums[c][a] = of.get(c, 0.0) + w
        for c, w in of.items():
            heapq.heappush(heap, (-(w / (len(members[a]) * len(members[c]))), min(a, c), max(a, c)))
    return {n: a for a, of in members.items() for n in of}


def _linkage(a: pd.Series, b: pd.Series, w: pd.Series) -> pd.Series:
    """Average linkage within components, each a row of arrays."""
    return pd.Series([list(average_linkage(zip(x.tolist(), y.tolist(), z.tolist())).items()) for x, y, z in zip(a, b, w)], dtype=object)


def _spread_linkage(links: DataFrame) -> DataFrame:
    """id, class: the same linkage for components too large for one task.

    Two groups that are each other's nearest are joined at once, all such
    pairs in one round of aggregations and joins; since a mean of means never
    exceeds the greater one, the outcome is that of joining one pair after the
    other. Rounds end when no two groups reach LINKAGE.
    """
    nodes = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    labels = cut_lineage(nodes.select("id", F.col("id").alias("class")))
    edges = cut_lineage(links.select("a", "b", F.col("cosine").alias("w")))
    while True:
        sizes = labels.groupBy("class").agg(F.count("*").alias("n"))
        held = edges.join(sizes.withColumnsRenamed({"class": "a", "n": "n_a"}), "a").join(sizes.withColumnsRenamed({"class": "b", "n": "n_b"}), "b")
        near = cut_lineage(held.select("a", "b", (F.col("w") / (F.col("n_a") * F.col("n_b"))).alias("mean")).where(F.col("mean") >= LINKAGE))
        rank = F.struct("mean", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))
        both = near.select(F.col("a").alias("g"), rank.alias("r")).unionByName(near.select(F.col("b").alias("g"), rank.alias("r")))
        best = both.groupBy("g").agg(F.max("r").alias("r")).select("g", (-F.col("r.x")).alias("a"), (-F.col("r.y")).alias("b"))
        joined = cut_lineage(best.groupBy("a", "b").agg(F.count("*").alias("k")).where("k = 2").select("a", "b"))
        if joined.isEmpty():
            return labels
        into = joined.select(F.col("b").alias("old"), F.col("a").alias("new"))
        labels = cut_lineage(labels.join(into, labels["class"] == into["old"], "left").select("id", F.coalesce("new", "class").alias("class")))
        moved = edges.join(into.withColumnsRenamed({"old": "a", "new": "a2"}), "a", "left").join(into.withColumnsRenamed({"old": "b", "new": "b2"}), "b", "left")
        moved = moved.select(F.coalesce("a2", "a").alias("x"), F.coalesce("b2", "b").alias("y"), "w").where("x <> y")
        edges = cut_lineage(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")))


def linked_classes(links: DataFrame) -> DataFrame:
    """id, class of every key that has a link (a, b, cosine): average linkage within connected components."""
    parts = connected_components(links, "a", "b").withColumnsRenamed({"node": "a"})
    placed = cut_lineage(links.join(parts, "a"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    small, large = sizes.where(F.col("n") <= IN_TASK), sizes.where(F.col("n") > IN_TASK)
    lists = placed.join(small.where("n > 1").select("component"), "component", "left_semi").groupBy("component").agg(F.collect_list(F.struct("a", "b", "cosine")).alias("of"))
    arrays = spread(lists, "component").select("of.a", "of.b", "of.cosine")
    grouped = F.pandas_udf(_linkage, "array<struct<id:bigint,class:bigint>>")("a", "b", "cosine")
    out = arrays.select(F.inline(grouped))
    # A component of one link needs no linkage: a cosine at or above COSINE reaches LINKAGE.
    lone = placed.join(small.where("n = 1").select("component"), "component", "left_semi")
    out = out.unionByName(lone.select(F.inline(F.array(*[F.struct(F.col(c).alias("id"), F.least("a", "b").alias("class")) for c in "ab"]))))
    if large.isEmpty():
        return out
    return out.unionByName(_spread_linkage(placed.join(large.select("component"), "component", "left_semi").select("a", "b", "cosine")))


def link_spellings(spellings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """spelling, key, class (of all spellings of one name): one row per different spelling.

    `known`: pairs of spellings (spelling_a, spelling_b) that a record itself
    gives for one name; their differing words are taken to mean the same.
    """
    key = F.pandas_udf(lambda s: s.map(lambda x: key_of(x) if x else None), "string")
    different = cut_lineage(spellings.where("spelling is not null").distinct().select("spelling", key("spelling").alias("key")).where("key <> ''"))
    keys = different.select("key").distinct().select(F.xxhash64("key").alias("id"), "key")
    if known is not None:
        known = known.where("spelling_a <> spelling_b").distinct().select(key("spelling_a").alias("key_a"), key("spelling_b").alias("key_b"))
        known = known.where("key_a <> '' and key_b <> '' and key_a <> key_b").distinct()
    links = cut_lineage(checked_links(keys, known))
    keyed = different.withColumn("id", F.xxhash64("key")).join(linked_classes(links), "id", "left")
    return keyed.select("spelling", "key", F.coalesce("class", "id").alias("class"))


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """spelling_a, spelling_b: all pairs of different spellings of one class, the smaller first."""
    # The result is these pairs; a class holds the ways of writing one name.
    a = linked.select("class", F.col("spelling").alias("spelling_a"))
    b = linked.select("class", F.col("spelling").alias("spelling_b"))
    return a.join(b, "class").where("spelling_a < spelling_b").select("spelling_a", "spelling_b")
