"""Deeply nested answers turned into flat, related tables.

The answer is parsed once into a variant. Nested `transform` calls then carry
the ancestors' keys and places down, `flatten` joins the arrays of a level,
and one `inline` per target table emits its rows. No shuffle takes place: a
row's children stay in the row's task.

Users are looked for, not expected: an object with a name or directories is
one, wherever it stands; objects, lists and texts holding JSON around it are
opened, up to WRAPS of them. Its place is that in the innermost list around it.

Defined results: text that isn't complete JSON (null, empty, cut off, markup)
yields no rows; a byte order mark before it is no fault, and of a key written
twice the last one counts. An object where a list belongs is a list of one;
null, absent or scalar levels are empty; null entries keep their place but
yield no row. Repeated answers are each turned under their own key. Further
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Objects, lists and texts that may stand around a user; how many of the outermost may be JSON texts.
WRAPS, TEXTS = 8, 4

_VARIANTS = "array<variant>"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parse_whole(text: Column) -> Column:
    """The text as a variant, or null where it isn't one complete JSON value.

    The parser stops after one value; wrapped in an enclosing one, whatever follows it is an error.
    """
    bare = F.regexp_replace(text, r"^[\x{FEFF}\s]+", "")
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit('[{"v":'), bare, F.lit("}]"))), "$[0].v", "variant")


def get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def is_object(value: Column) -> Column:
    """Without looking at the fields: an object passes for a struct of none."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def as_list(value: Column) -> Column:
    """A list stays, an object becomes a list of one, anything else an empty list."""
    return bound(value, lambda v: F.coalesce(F.try_variant_get(v, "$", _VARIANTS), F.when(is_object(v), F.array(v)), F.array().cast(_VARIANTS)))


def _placed(no: Column, value: Column) -> Column:
    return F.struct(no.cast("int").alias("no"), value.alias("v"))


def _opened(found: Column, with_texts: bool) -> Column:
    """Of values with their places: users stay, lists, objects and texts give what they hold, anything else falls away."""
    none = F.array().cast("array<struct<no:int,v:variant>>")

    def one(x: Column) -> Column:
        v = x["v"]
        is_user = is_object(v) & (get(v, "directories", "variant").isNotNull() | get(v, "username", "variant").isNotNull())
        members = F.transform(F.try_variant_get(v, "$", _VARIANTS), lambda e, i: _placed(i, e))
        fields = F.transform(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: _placed(x["no"], e))
        out = F.when(is_user, F.array(x)).otherwise(F.coalesce(members, fields, none))
        if with_texts:
            text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
            out = F.when(is_user, F.array(x)).otherwise(F.coalesce(members, fields, bound(text, lambda t: F.when(t.rlike(r"^\s*[\x{FEFF}\[{\"]"), F.array(_placed(x["no"], parse_whole(t))))), none))
        return F.filter(out, lambda y: y["v"].isNotNull())

    return F.flatten(F.transform(found, one))


def _user(x: Column) -> Column:
    return F.struct(x["no"].alias("user_no"), get(x["v"], "username", "string").alias("username"), as_list(get(x["v"], "directories", "variant")).alias("directories"))


def _directory(u: Column, d: Column, j: Column) -> Column:
    return F.struct(
        u["user_no"].alias("user_no"),
        j.alias("directory_no"),
        get(d, "directory", "string").alias("directory"),
        get(d, "fileCount", "int").alias("file_count"),
        as_list(get(d, "files", "variant")).alias("files"),
        is_object(d).alias("here"),
    )


#: Fields of a file: column, name in the answer, type.
FILE_FIELDS = (
    ("id", "id", "string"), ("direction", "direction", "string"), ("filename", "filename", "string"),
    ("size", "size", "bigint"), ("state", "state", "string"), ("requested_at", "requestedAt", "string"),
    ("ended_at", "endedAt", "string"), ("bytes_transferred", "bytesTransferred", "bigint"),
    ("average_speed", "averageSpeed", "double"), ("percent_complete", "percentComplete", "double"),
)


def _file(d: Column, f: Column, k: Column, fields: Sequence[tuple[str, str, str]]) -> Column:
    return F.struct(
        d["user_no"].alias("user_no"),
        d["directory_no"].alias("directory_no"),
        k.alias("file_no"),
        *[get(f, name, kind).alias(column) for column, name, kind in fields],
        is_object(f).alias("here"),
    )


def flat_tables(answers: DataFrame, keys: Sequence[str], payload: str, fields: Sequence[tuple[str, str, str]] = FILE_FIELDS) -> dict[str, DataFrame]:
    """users, directories and files of every answer, each with the places of its ancestors; files with the fields asked for.

    Sets spark.sql.variant.allowDuplicateKeys of the session, without which an answer with a key written twice can't be read.
    """
    answers.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    found = F.array(_placed(F.lit(0), parse_whole(F.col(payload))))
    for i in range(WRAPS):
        found = _opened(found, i < TEXTS)
    users = answers.select(*keys, F.transform(found, _user).alias("__users"))
    directories = users.select(
        *keys,
        F.filter(F.flatten(F.transform("__users", lambda u: F.transform(u["directories"], lambda d, j: _directory(u, d, j)))), lambda d: d["here"]).alias("__dirs"),
    )
    files = directories.select(
        *keys,
        F.filter(F.flatten(F.transform("__dirs", lambda d: F.transform(d["files"], lambda f, k: _file(d, f, k, fields)))), lambda f: f["here"]).alias("__files"),
    )
    levels = {"users": (users, "__users"), "directories": (directories, "__dirs"), "files": (files, "__files")}
    # The outer form, without the rows it makes of empty lists: for the plain one the optimiser would work the list out twice, once to see whether it is empty.
    return {name: level.select(*keys, F.inline_outer(F.col(column))).where("user_no is not null").drop("here", "directories", "files") for name, (level, column) in levels.items()}
