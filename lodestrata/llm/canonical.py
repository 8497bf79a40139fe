"""Freely typed values mapped to the entries of a reference list.

The entries and their other names stand in BK-trees under the
Damerau-Levenshtein distance, a true metric. A lookup walks only the subtrees
the triangle inequality leaves open and returns every name within the
threshold; the nearest wins. A list of up to SHARD names goes to the tasks
whole, and values are looked up where they stand. A larger one is cut into
shards, each with its own tree; the distinct values, in blocks, meet every
shard, and the winners of the shards are merged and joined back. Values
looked up are kept, so one typed a million times costs few walks. Other names
of the entries are an input table; the names below are its default.

Defined results: null and blank values yield no row; a value that is exactly
an entry is not a case; a value with no name within its threshold, or with
several entries equally near, is unmatched (-1); repeated rows are mapped
each under its own key.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Names per tree, values of a block that meets a shard, values a task keeps the answers of, and the distance allowed by the length of the value.
SHARD, BLOCK, KEPT = 20_000, 50_000, 200_000
SLIPS = ((3, 0), (11, 1), (10_000, 2))

# Other names of entries, after a colon, in the languages of the tables.
OTHER_NAMES = {
    "media_grade": """
Mint (M): m, mint, mint/sealed, sealed, still sealed, ss, new, brand new, novo, nova, lacrado, nuevo, nueva, precintado, neuf
Near Mint (NM or M-): nm, nm or m-, nm/m-, m-, m/nm, near mint, nearly mint, nr mint, n mint, n.m., mint minus, mint -, quase novo, quase nova, seminovo, casi nuevo, casi nueva, presque neuf, comme neuf, like new, excellent, ex, excelente
Very Good Plus (VG+): vg+, vg +, vgp, v.g.+, vg plus, very good+, very good +, very good plus, muito bom +, muito bom mais, muy bueno +, muy bueno plus, très bon +, très bon plus
Very Good (VG): vg, v.g., very good, v. good, v good, muito bom, muito boa, muy bueno, muy buena, très bon, très bon état
Good Plus (G+): g+, g +, gp, good+, good +, good plus, g plus, bom +, bom mais, bueno +, bueno plus, bon +, bon plus
Good (G): g, good, bom, boa, bueno, buena, bon, bon état
Fair (F): f, fair, regular, razoável, aceitável, aceptable, moyen, passable
Poor (P): p, poor, ruim, péssimo, mau, malo, mala, muy malo, mauvais, bad
""",
    "country": """
UK: u.k., great britain, g.b., united kingdom, britain, england, gran bretaña, grã-bretanha, grande-bretagne, inglaterra, angleterre
US: u.s., u.s.a., usa, united states, united states of america, america, the states, eua, e.u.a., ee.uu., eeuu, estados unidos da américa, états-unis
Netherlands: the netherlands, holland, holanda, hollande, países bajos, países baixos, paises baixos
South Korea: korea, korea (south), republic of korea, rep. of korea, coreia do sul, corea del sur, corée du sud, s. korea, hanguk
Czech Republic: czechia, czech rep., rep. tcheca, república tcheca, república checa, rep. checa, tchéquie, česko, česká republika
Russia: russian federation, federação russa, rossiya
Argentina: rep. argentina, república argentina
South Africa: rsa, s. africa, republic of south africa, áfrica do sul, sudáfrica
New Zealand: n. zealand, n.z., aotearoa, nova zelândia, nueva zelanda
Japan: nippon, nihon
Greece: hellas, ellada, hellada
India: bharat
Ireland: éire, eire, rep. of ireland, republic of ireland
Switzerland: ch, schweiz, suisse, svizzera, helvetia
Finland: suomi
Turkey: türkiye, turkiye, turquie
Brazil: brazil (br)
Cape Verde: cabo verde, c. verde
Germany: brd, west germany, frg, ger
Iceland: ísland, island
Mozambique: moçambique
""",
    "categories": """
Bossa Nova: bossa, bossanova, b. nova, b nova
MPB: música popular brasileira, m.p.b., brazilian popular music
Choro: chorinho
Jazz-Funk: jazz funk, jazzfunk
Hard Bop: hardbop
Free Improvisation: free improv, free impro, improvisação livre, improvisación libre, improvisation libre
Hip Hop: hiphop, hip-hop, rap, hip hop/rap
Drum n Bass: dnb, d&b, d'n'b, drum and bass, drum & bass, drum'n'bass, drum n' bass
House: house music
Techno: tekno, techno music
Ambient: ambiente, ambient music
Soundtrack: ost, original soundtrack, sound track, score, trilha sonora, banda sonora, bande originale
Contemporary R&B: r&b, rnb, r and b, r'n'b, contemporary rnb, rhythm and blues
Soul: soul music
Disco: disco music
Dub: dub reggae
Flamenco: flamenco/gitano
Chanson: chanson française
Classical: classical music, clássica, música clássica, clásica, música clásica, classique, klassik
Baroque: barroco, barroca, barock
Opera: ópera, opéra, oper
Psychedelic Rock: psychedelic, psych rock, psych-rock, psych, rock psicodélico, psicodelia
Progressive Rock: prog, prog rock, rock progressivo, rock progresivo, progressive
Punk: punk rock
Post-Punk: post punk, postpunk, pós-punk
Heavy Metal: heavy, metal, metal pesado
Folk: folk music, folclore, folklore
Country: country music, c&w, country & western
Bluegrass: blue grass
Electronic: electronica, eletrônica, electrónica, électronique, elektronik, electronic music
Synth-Pop: synth pop, synthpop
Spoken Word: spokenword, palavra falada, palabra hablada
Children's: infantil, kids, childrens, children, crianças, niños, enfants
Christmas: natal, navidad, noël, xmas
Gospel: gospel music
Afrobeat: afro beat, afro-beat
Highlife: high life, hi-life, hi life
Field Recording: field recordings, gravação de campo, grabación de campo, field rec
Reggae: reggae music, regge
""",
}
#: Entries of countries whose English name is another.
_ISO = {"UK": "GB", "US": "US", "Czech Republic": "CZ", "Turkey": "TR", "Cape Verde": "CV"}
_LANGUAGES = "en pt es fr de it nl sv nb da fi pl cs el tr ru ja ko hu is ga hi".split()


def _english_countries(spark: SparkSession) -> list[str]:
    locale = spark.sparkContext._jvm.java.util.Locale
    english = locale.forLanguageTag("en")
    return [locale.forLanguageTag(f"und-{code}").getDisplayCountry(english) for code in locale.getISOCountries()]


def country_names(spark: SparkSession, entries: Sequence[str]) -> dict[str, set[str]]:
    """Codes and the names in many languages that the JVM's locales give for each entry."""
    locale = spark.sparkContext._jvm.java.util.Locale
    languages = [locale.forLanguageTag(x) for x in _LANGUAGES]
    english = {locale.forLanguageTag(f"und-{code}").getDisplayCountry(languages[0]): code for code in locale.getISOCountries()}
    out = {}
    for entry in entries:
        code = _ISO.get(entry) or english.get(entry)
        if code:
            own = locale.forLanguageTag(f"und-{code}")
            out[entry] = {code, own.getISO3Country(), *(own.getDisplayCountry(x) for x in languages)}
    return out


def folded(value: str) -> str:
    """Case, accents and runs of spaces aside."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", value.casefold()) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", bare).strip()


def light(value: str) -> str:
    """Outer marks aside too."""
    return folded(value).strip(" ?!.,;:'\"")


def squashed(value: str) -> str:
    """Letters, digits and plus signs only."""
    return re.sub(r"[^\w+]|_", "", light(value))


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance without restriction, a metric."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


class BKTree:
    """Names under the distance; each edge holds the distance of a child to its parent."""

    def __init__(self, names: Sequence[str]):
        self.nodes: list[str] = []
        self.children: list[dict[int, int]] = []
        for name in names:
            self._add(name)

    def _add(self, name: str) -> None:
        if not self.nodes:
            self.nodes.append(name)
            self.children.append({})
            return
        at = 0
        while True:
            d = distance(name, self.nodes[at])
            if d == 0:
                return
            if d not in self.children[at]:
                self.children[at][d] = len(self.nodes)
                self.nodes.append(name)
                self.children.append({})
                return
            at = self.children[at][d]

    def within(self, value: str, most: int) -> list[tuple[int, str]]:
        """Every name at a distance of at most `most`, with its distance."""
        out, stack = [], [0] if self.nodes else []
        while stack:
            at = stack.pop()
            d = distance(value, self.nodes[at])
            if d <= most:
                out.append((d, self.nodes[at]))
            stack += [child for edge, child in self.children[at].items() if d - most <= edge <= d + most]
        return out


def forms_of(value: str) -> list[str]:
    return list(dict.fromkeys((folded(value), light(value), light(value.strip("() []?.")), squashed(value))))


class Reference:
    """The names of one field's entries."""

    def __init__(self, names: dict[str, set[tuple[int, str]]]):
        self.names = names
        self.tree = BKTree(sorted(names))
        self.longest = max(map(len, names), default=0)
        self.kept: dict[str, int] = {}

    def meant(self, value: str) -> int:
        if value not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            # The tree is walked only where no form of the value is a name.
            found = chosen(value, self.exact(value))
            self.kept[value] = found if found >= 0 else chosen(value, self.near(value))
        return self.kept[value]

    def exact(self, value: str) -> list[tuple[int, int, str]]:
        """(distance, entry, name) of names that a form of the value is; the distance is negative and tells the form."""
        forms = forms_of(value)
        return [(k - len(forms), i, name) for k, form in enumerate(forms) for i, name in self.names.get(form, ())]

    def near(self, value: str) -> list[tuple[int, int, str]]:
        """The same, and every name near the value with its distance."""
        out = self.exact(value)
        for form in forms_of(value):
            most = next((k for length, k in SLIPS if len(form) <= length), SLIPS[-1][1])
            # A form longer than every name by more than the slips is near none.
            if most and len(form) <= self.longest + most:
                for d, name in self.tree.within(form, most):
                    # Short names take no slip; neither does a name that would lose a third of itself.
                    if d == 0 or len(name) > 3 and d * 3 < max(len(name), len(form)) + 1:
                        out += [(d, i, of) for i, of in self.names[name]]
        return out


def chosen(value: str, near: Iterable[tuple[int, int, str]]) -> int:
    """The entry meant among the names near a value, -1 if none or several equally near."""
    best: dict[int, set[tuple[int, str]]] = {}
    for d, i, name in near:
        best.setdefault(d, set()).add((i, name))
    for d in sorted(d for d in best if d < 0):
        if len(ids := {i for i, _ in best[d]}) == 1:
            return next(iter(ids))
    far = [d for d in best if d >= 0]
    if not far:
        return -1
    nearest = best[min(far)]
    if len({i for i, _ in nearest}) > 1:
        # Equally near: what is nearer with accents and marks as written.
        written = value.casefold()
        apart = {(i, name): distance(written, name.casefold()) for i, name in nearest}
        nearest = {x for x, d in apart.items() if d == min(apart.values())}
    ids = {i for i, _ in nearest}
    return next(iter(ids)) if len(ids) == 1 else -1


_LATEST: list = [None, None]


def _held(sent) -> dict[str, Reference]:
    """The references of a list sent to the tasks, built once per Python process."""
    if _LATEST[0] is not sent.value:
        of: dict[str, dict[str, set[tuple[int, str]]]] = {}
        for field, form, i, name in sent.value:
            of.setdefault(field, {}).setdefault(form, set()).add((i, name))
        _LATEST[:] = [sent.value, {field: Reference(names) for field, names in of.items()}]
    return _LATEST[1]


def default_names(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """field_name, canonical, name: the fixed other names, and for countries those of the JVM's locales (some thousands, whatever the list)."""
    rows = []
    for field, lines in OTHER_NAMES.items():
        for line in lines.strip().splitlines():
            name, _, more = line.partition(": ")
            rows += [(field, name, m.strip()) for m in more.split(",")]
    # Of at most some 250 countries, those that are listed.
    listed = entries.where((F.col("field_name") == "country") & F.col("canonical").isin([*_ISO, *_english_countries(spark)])).select("canonical").distinct()
    countries = [r["canonical"] for r in listed.collect()]
    for name, more in country_names(spark, countries).items():
        rows += [("country", name, m) for m in sorted(more)]
    return spark.createDataFrame(rows, "field_name string, canonical string, name string")


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for field, i, canonical, name in zip(batch["field_name"], batch["value_id"], batch["canonical"], batch["name"]):
            bracketed = {re.sub(r"\s*\(.*\)", "", name)} if field != "media_grade" else set()
            plural = {name + "s"} if field == "categories" and name == canonical else set()
            for x in {name} | bracketed | plural:
                # A closing minus tells grades apart and would be lost.
                rows += [(field, form, i, x) for form in {folded(x), light(x), squashed(x) if not x.endswith("-") else ""} if form]
        yield pd.DataFrame(rows, columns=["field_name", "form", "value_id", "name"])


def name_forms(entries: DataFrame, other_names: DataFrame) -> DataFrame:
    """field_name, form, value_id, name: every form under which an entry may be found."""
    listed = entries.select("field_name", "value_id", "canonical").dropna().distinct()
    named = listed.join(other_names.select("field_name", "canonical", "name").dropna().where("trim(name) <> ''"), ["field_name", "canonical"])
    every = listed.withColumn("name", F.col("canonical")).unionByName(named.select("field_name", "value_id", "canonical", "name"))
    return every.mapInPandas(_forms, "field_name string, form string, value_id bigint, name string").distinct()


def typed_values(records: DataFrame, record_id: str) -> DataFrame:
    """record_id, field_name, item_no, typed: trimmed, blank ones left out, categories item by item."""
    def one(field: str):
        return F.array(F.trim(field))

    items = F.transform(F.split("categories", "[;,]"), lambda x: F.trim(x))
    fields = F.array(*[
        F.struct(F.lit(name).alias("field_name"), F.filter(values, lambda v: v.isNotNull() & (v != "")).alias("values"))
        for name, values in (("media_grade", one("media_grade")), ("country", one("country")), ("categories", items))
    ])
    per_field = records.select(F.col(record_id).alias("record_id"), F.inline(fields))
    return per_field.select("record_id", "field_name", F.posexplode("values").alias("item_no", "typed"))


def map_values(values: DataFrame, entries: DataFrame, other_names: DataFrame | None = None) -> DataFrame:
    """record_id, field_name, item_no, typed, value_id (-1: none meant) of the values that aren't exactly an entry.

    `other_names` (field_name, canonical, name): how else entries are called; default_names where absent.
    """
    spark = values.sparkSession
    forms = cut_lineage(name_forms(entries, default_names(spark, entries) if other_names is None else other_names))
    exact = entries.select("field_name", F.col("canonical").alias("typed")).dropna().distinct()
    if forms.limit(SHARD + 1).count() > SHARD:
        cases = values.join(exact, ["field_name", "typed"], "left_anti")
        return cases.join(_by_shards(cases.select("field_name", "typed").distinct(), forms), ["field_name", "typed"]).select("record_id", "field_name", "item_no", "typed", "value_id")
    sent = spark.sparkContext.broadcast([tuple(r) for r in forms.select("field_name", "form", "value_id", "name").collect()])
    known = spark.sparkContext.broadcast({tuple(r) for r in exact.join(forms.select("field_name").distinct(), "field_name", "left_semi").select("field_name", "typed").collect()})

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, none = _held(sent), Reference({})
        for batch in batches:
            out = batch[[(f, t) not in known.value for f, t in zip(batch["field_name"], batch["typed"])]].copy()
            out["value_id"] = [held.get(f, none).meant(t) for f, t in zip(out["field_name"], out["typed"])]
            yield out

    return values.select("record_id", "field_name", "item_no", "typed").mapInPandas(look_up, "record_id bigint, field_name string, item_no int, typed string, value_id bigint")


def _by_shards(typed: DataFrame, forms: DataFrame) -> DataFrame:
    """field_name, typed, value_id of distinct values: every block of values meets every shard of names, the nearest of all shards wins."""
    shards = max(1, -(-forms.count() // SHARD))
    typed = cut_lineage(typed)
    blocks = max(1, -(-typed.count() // BLOCK))
    values = typed.withColumn("block", F.pmod(F.xxhash64("field_name", "typed"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    names = forms.withColumn("shard", F.pmod(F.xxhash64("form"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def meet(asked: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        of: dict[str, dict[str, set[tuple[int, str]]]] = {}
        for field, form, i, name in zip(listed["field_name"], listed["form"], listed["value_id"], listed["name"]):
            of.setdefault(field, {}).setdefault(form, set()).add((i, name))
        held = {field: Reference(x) for field, x in of.items()}
        rows = [(f, t, d, i, name) for f, t in zip(asked["field_name"], asked["typed"]) if f in held for d, i, name in held[f].near(t)]
        return pd.DataFrame(rows, columns=["field_name", "typed", "d", "i", "name"])

    near = values.groupBy("shard", "block").cogroup(names.groupBy("shard", "block")).applyInPandas(meet, "field_name string, typed string, d int, i bigint, name string")
    near = near.groupBy("field_name", "typed").agg(F.collect_set(F.struct("d", "i", "name")).alias("near"))

    @F.pandas_udf("bigint")
    def choose(value: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series([-1 if n is None else chosen(v, [(x["d"], x["i"], x["name"]) for x in n]) for v, n in zip(value, of)], dtype="int64")

    return typed.join(near, ["field_name", "typed"], "left").select("field_name", "typed", choose("typed", "near").alias("value_id"))
