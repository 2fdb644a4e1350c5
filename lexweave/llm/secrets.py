"""Secret scans: spans by pattern, and corpus-wide ownership of every candidate value."""
from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import let, unused
from lexweave.sources.tables import stage


class Kind(NamedTuple):
    """A pattern, the group whose length counts, and the least length; shorter matches are dropped after matching."""
    name: str
    pattern: str
    group: int
    least: int
    needs: tuple[str, ...] = ()


#: The base kinds, in the order in which they are listed.
BASE = (
    Kind("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", r"[0-9a-f]+", 0, 24),
)
#: Further candidates, which count as secrets only when their owners are few: long runs of mixed letters and digits.
EXTRA = (Kind("mixed", r"[A-Za-z0-9+/_-]{24,}", 0, 24, ("[0-9]", "[a-z]", "[A-Z]")),)
#: Runs below the least length cannot hide a later match of these kinds, so the scan may skip them at once.
FAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: A value is widely copied if this share of all owners holds it, and this many; of few owners, all but one are enough.
OWNER_SHARE = 0.1
LEAST_OWNERS = 5
#: Likewise of repositories, if more than one owner has it.
REPOSITORY_SHARE = 0.01
LEAST_REPOSITORIES = 100


def running(values: Column) -> Column:
    """Running sums of an array of numbers; each step copies what it has, so use it on short arrays."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("sums"))
    return F.aggregate(values, zero, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["sums"], F.array(a["at"] + v)).alias("sums")), lambda a: a["sums"])


def running_sums(values: Column) -> Column:
    """Running sums of a long array: block by block, of about the root of its length, then the blocks' offsets."""
    def blocks(v):
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda j: running(F.slice(v, j * width + 1, width)))
    def shifted(parts):
        return let(running(F.transform(parts, lambda p: F.element_at(p, -1))), lambda offs: F.flatten(
            F.transform(parts, lambda p, j: F.transform(p, lambda x: x + F.when(j > 0, F.get(offs, j - 1)).otherwise(0)))))
    return F.when(F.size(values) > 0, let(values, lambda v: let(blocks(v), shifted))).otherwise(F.array().cast("array<bigint>"))


def kind_spans(text: Column, kind: Kind) -> Column:
    """All matches of one kind as an array of (start, end, kind, value), counted in characters.

    The text is split at the pattern; the lengths of gaps and matches, added up, give the places.
    """
    pattern = FAST.get(kind.name, kind.pattern)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if kind.group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(kind.group))

    def place(m):
        steps = F.zip_with(F.slice(m["gaps"], F.lit(1), F.size(m["whole"])), m["whole"], lambda g, w: (F.char_length(g) + F.char_length(w)).cast("long"))
        return let(running_sums(steps), lambda ends: F.transform(m["whole"], lambda w, i: F.struct(
            (F.get(ends, i) - F.char_length(w)).cast("int").alias("start"), F.get(ends, i).cast("int").alias("end"),
            F.lit(kind.name).alias("kind"), F.get(m["value"], i).alias("value"))))

    def kept(s):
        ok = F.char_length(s["value"]) >= kind.least
        for needed in kind.needs:
            ok = ok & s["value"].rlike(needed)
        return ok

    made = let(F.struct(whole.alias("whole"), value.alias("value"), F.split(text, pattern).alias("gaps")), place)
    return F.when(text.rlike(pattern), F.filter(made, kept)).otherwise(
        F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>"))


def candidates_of(text: Column, kinds: tuple[Kind, ...]) -> Column:
    """The spans of all kinds in order of start, then kind as listed; of the value only its digest is kept."""
    t = F.coalesce(text, F.lit(""))
    number = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k.name), F.lit(i))])
    return F.array_sort(F.transform(F.concat(*[kind_spans(t, k) for k in kinds]), lambda s: F.struct(
        s["start"].alias("start"), number[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
        F.sha2(s["value"], 256).alias("hash"), F.char_length(s["value"]).alias("length"))))


def candidates(docs: DataFrame, text: str, keep: tuple[str, ...], kinds: tuple[Kind, ...]) -> DataFrame:
    return docs.select(*keep, candidates_of(F.col(text), kinds).alias("found"))


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """Per value hash: how often it stands, in how many distinct repositories and of how many distinct owners.

    Repeats are folded before each shuffle; repositories and owners are each counted after their pairs with
    the hash were made distinct, so a value that a third of all rows hold is a few rows by then.
    """
    seen = found.select(F.explode("found").alias("s"), F.col(repository).alias("r"), F.col(owner).alias("o")).select("s.hash", "r", "o")
    folded = seen.groupBy("hash", "r", "o").agg(F.count("*").alias("n"))
    by_owner = folded.groupBy("hash", "o").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.sum("n").alias("occurrences"), F.count("o").alias("owners"))
    by_repository = folded.select("hash", "r").distinct().groupBy("hash").agg(F.count("r").alias("repositories"))
    return by_owner.join(by_repository, "hash")


class Enough(NamedTuple):
    """So many owners, or two owners and so many repositories, make a value a widely copied example."""
    owners: int
    repositories: int


def widely(all_owners: int, owner_share: float = OWNER_SHARE, least_owners: int = LEAST_OWNERS) -> int:
    """How many owners make a value an example, never fewer than two."""
    return max(2, min(least_owners, all_owners - 1), math.ceil(owner_share * all_owners))


def verdict(enough: Enough) -> Column:
    """``example``: a good share of all owners, or of all repositories and not of one owner alone; otherwise it looks ``live``."""
    copied = (F.col("owners") >= enough.owners) | ((F.col("owners") >= 2) & (F.col("repositories") >= enough.repositories))
    return F.when(copied, "example").otherwise("live")


def bounds_of(rows: DataFrame, repository: str, owner: str, owner_share: float, least_owners: int) -> Enough:
    """The bounds for all rows, with candidates or without."""
    owners, repositories = (rows.select(c).where(F.col(c).isNotNull()).distinct().count() for c in (owner, repository))
    return Enough(widely(owners, owner_share, least_owners), max(LEAST_REPOSITORIES, math.ceil(REPOSITORY_SHARE * repositories)))


FOUND = ("start", "rank", "end", "kind", "hash", "length")


def key_of(found: Column, *columns: Column) -> Column:
    """What rows with the same candidates share; rows without any are spread by their own columns."""
    spread = F.concat(F.lit("-"), F.xxhash64(*columns).cast("string")) if columns else F.lit(None)
    return F.when(F.size(found) > 0, F.sha2(F.to_json(found), 256)).otherwise(spread)


def judged(rows: DataFrame, repository: str, owner: str, enough: Enough) -> DataFrame:
    """Per distinct list of candidates (``key``) the spans that are reported, each with its owners and verdict."""
    holders = rows.where(F.size("found") > 0)
    stats = ownership(holders, repository, owner).withColumn("verdict", verdict(enough))
    each = holders.select("key", "found").distinct().select("key", F.explode("found").alias("s")).select("key", "s.*")
    told = each.join(stats, "hash").where(~F.col("kind").isin([k.name for k in EXTRA]) | (F.col("verdict") == "live"))
    return told.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*FOUND, "owners", "repositories", "verdict"))).alias("spans"))


def scan(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", keep: tuple[str, ...] = ("doc_id",),
         owner_share: float = OWNER_SHARE, least_owners: int = LEAST_OWNERS) -> DataFrame:
    """The ``keep`` columns of every row and ``spans``: array of (start, rank, end, kind, hash, length, owners, repositories, verdict).

    Base kinds are always reported; candidates of the further kinds only if they look live: a value that a good
    share of all owners hold, or of all repositories under more than one owner, is a copied example. Null and empty texts have no
    spans; a null owner or repository counts as none; repeated rows are reported each but count once as
    repository; an empty table gives an empty one; columns of ``keep`` must not be called found, key or spans.
    The candidates are staged, since two steps read them; texts are read once and never shuffled.
    """
    cols = tuple(dict.fromkeys((*keep, repository, owner)))
    rows = candidates(docs, text, cols, BASE + EXTRA)
    rows = stage(rows.withColumn("key", key_of(F.col("found"), *map(F.col, cols))), "secrets")
    spans = judged(rows, repository, owner, bounds_of(rows, repository, owner, owner_share, least_owners))
    joined = rows.select(*keep, "key").join(spans, "key", "left")
    return joined.select(*keep, F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with ``mark`` in place of every span; spans may overlap and must be sorted by start."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    def step(a, s):
        gap = F.when(s["start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], gap).alias("out"))
    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", mark: str = "[secret]",
           owner_share: float = OWNER_SHARE, least_owners: int = LEAST_OWNERS) -> DataFrame:
    """``docs`` with live secrets replaced in the text; copied examples stay.

    Candidates are evaluated once, into a staged copy of the rows; rows without any are not shuffled. Null and
    empty texts stay as they are; repeated rows are each struck; an empty table gives an empty one; further columns may have any name.
    """
    found, key, live = unused(docs.columns, "found", "key", "live")
    held = stage(docs.withColumn(found, candidates_of(F.col(text), BASE + EXTRA)), "redact")
    rows = held.where(F.size(found) > 0).select(*dict.fromkeys((repository, owner)), F.col(found).alias("found"), key_of(F.col(found)).alias("key"))
    told = judged(rows, repository, owner, bounds_of(held, repository, owner, owner_share, least_owners)).select(
        F.col("key").alias(key), F.filter("spans", lambda s: s["verdict"] == "live").alias(live)).where(F.size(live) > 0)
    plain = held.where(F.size(found) == 0).select(*docs.columns)
    some = held.where(F.size(found) > 0).withColumn(key, key_of(F.col(found))).join(told, key, "left")
    clean = F.when(F.col(live).isNull(), F.col(text)).otherwise(redacted(F.col(text), F.col(live), mark))
    return plain.unionByName(some.select(*[clean.alias(c) if c == text else F.col(c) for c in docs.columns]))
