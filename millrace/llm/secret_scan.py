"""Secret scans by corpus-wide ownership: what many owners hold is an example, what one owner holds alone may be live.

A text is read once. Each kind's pattern cuts it into matches and the pieces between them, of which only lengths and a
128-bit hash of the secret are kept, and is written down so; every later step reads those rows and no text. A match's
place is the running sum of the lengths before it. The hashes are counted by distinct repositories and owners: first
each (secret, owner, repository) is one row, then repositories are counted for each owner, then owners, so that a secret
that a third of all documents hold is summed up before each shuffle.

Base kinds stay whatever their verdict. Added kinds, which would be guesses on their own, stay unless the corpus shows
their secret to be widely copied: in more than ``max_owners`` owners or ``max_repos`` repositories. Only copied secrets are
met with the matches. Those that stand for more than a hundred-thousandth of all matches are a hundred thousand at most
and are broadcast, so their matches stay where they are; the others are small and met by a shuffle.

Cases, all defined: a null or empty text holds nothing. Places are code points, ends exclusive. A null owner is an
owner and a null repository a repository. Rows that share id and text are one document and get equal results; rows that
share an id but not the text each have their own. An empty table gives an empty result. Texts are read whole; other
columns than the four named are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage

#: The base patterns. A letter of the first pattern's names stands in either case.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
#: All of a run of hex digits that is long enough; shorter runs need not be matched to be left out.
HEX = r"([0-9a-f]{24,})"
PRIVATE = r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"
PREFIXED = r"((?:gh[pousr]_|xox[abprs]-|sk_live_|AIza|glpat-)[A-Za-z0-9_-]{16,})"
OPAQUE = r"([A-Za-z0-9_-]{24,})"
#: The first number of a match's hash seed; the second is this and one.
SEED = 1
HOT_MATCHES, HOT_SECRETS = 1_000, 100_000


@dataclass(frozen=True)
class Kind:
    """A pattern whose first group is the secret; ``base`` kinds are never dropped."""

    name: str
    pattern: str
    least: int = 0
    base: bool = True
    mixed: bool = False


KINDS = (
    Kind("assign", ASSIGN, 6), Kind("access", ACCESS, 20), Kind("hex", HEX, 24),
    Kind("private", PRIVATE, base=False), Kind("prefixed", PREFIXED, base=False), Kind("opaque", OPAQUE, 24, False, True),
)
#: Different characters that an opaque secret must have.
MIXED_CHARS = 12


@dataclass(frozen=True)
class Rules:
    max_owners: int = 2
    max_repos: int = 10


def _passes(kind: Kind, secret: Column) -> Column:
    passes = F.char_length(secret) >= kind.least
    if kind.mixed:
        varied = F.size(F.array_distinct(F.split(secret, ""))) >= MIXED_CHARS
        passes &= secret.rlike("[a-z]") & secret.rlike("[A-Z]") & secret.rlike("[0-9]") & varied
    return passes


def _matches(kind: Kind, number: int, text: Column) -> Column:
    """A row for each match: its kind, the characters before it since the last, its own, and its secret's hash, null if it fails."""
    pattern = F.lit(kind.pattern)
    zipped = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("secret"),
    )

    def row(z: Column) -> Column:
        passes = _passes(kind, z["secret"])
        hashes = [F.when(passes, F.xxhash64(F.lit(SEED + i), z["secret"])).alias(f"h{i}") for i in range(2)]
        return F.struct(F.lit(number).alias("kind"), F.char_length(z["gap"]).alias("gap"), F.char_length(z["match"]).alias("chars"), *hashes)

    found = F.transform(F.filter(zipped, lambda z: z["match"].isNotNull()), row)
    return F.when(text.rlike(kind.pattern), found).otherwise(F.array().cast(ROWS))


ROWS = "array<struct<kind:int,gap:int,chars:int,h0:bigint,h1:bigint>>"


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """``doc_id, t0, t1, owner, repo, found``: the matches of each row's whole text, kind by kind, with the text's hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*(_matches(kind, i, text) for i, kind in enumerate(KINDS)))
    hashes = [F.xxhash64(F.lit(i), text).alias(f"t{i}") for i in range(2)]
    owner, repo = F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo")
    return docs.select(F.col(id_col).alias("doc_id"), *hashes, owner, repo, found.alias("found"))


def placed(found: DataFrame) -> DataFrame:
    """``doc_id, t0, t1, owner, repo, kind, start, end, h0, h1`` for every match that passes, repeated rows once.

    A document's matches of one kind are one window; it streams, so a text may have any number of them.
    """
    keys = ["doc_id", "t0", "t1"]
    once = found.where(F.size("found") > 0).groupBy(*keys, "owner", "repo").agg(F.first("found").alias("found"))
    rows = once.select(*keys, "owner", "repo", F.posexplode("found").alias("nth", "m")).select(*keys, "owner", "repo", "nth", "m.*")
    upto = Window.partitionBy(*keys, "owner", "repo", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("chars")).over(upto)
    spans = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("chars"))
    return spans.where("h0 IS NOT NULL").select(*keys, "owner", "repo", "kind", "start", "end", "h0", "h1")


def ownership(spans: DataFrame) -> DataFrame:
    """``h0, h1, n_repos, n_owners, n_matches`` for every secret."""
    by_repo = spans.groupBy("h0", "h1", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("h0", "h1", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("h0", "h1").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_matches"))


def judged(spans: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``spans`` with ``copied``: whether the secret is widely copied."""
    owners = ownership(spans).where((F.col("n_owners") > rules.max_owners) | (F.col("n_repos") > rules.max_repos))
    owners = cut_lineage(owners)
    hot = F.col("n_matches") > max(HOT_MATCHES, spans.count() // HOT_SECRETS)
    few = F.broadcast(owners.where(hot).select("h0", "h1", F.lit(True).alias("_hot")))
    many = owners.where(~hot).select("h0", "h1", F.lit(True).alias("_copied"))
    here = spans.join(few, ["h0", "h1"], "left")
    known = here.where("_hot").withColumn("copied", F.lit(True))
    others = here.where("_hot IS NULL").join(many, ["h0", "h1"], "left").withColumn("copied", F.col("_copied").isNotNull()).drop("_copied")
    return known.unionByName(others).drop("_hot")


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    text = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(text, ",")


def _count_of(kind: int) -> Column:
    return F.size(F.filter("_all", lambda s: s["kind"] == kind))


def scan(
    docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
) -> DataFrame:
    """One row for each row of ``docs``: counts by base kind, its spans, and how many of all are live-looking or copied.

    ``doc_id, n_assign, n_access, n_hex, base_spans, spans, n_live, n_copied``; spans are ``kind:start:end``, by start and
    then kind, joined by commas. ``n_copied`` also counts the added spans that were dropped for it.
    """
    found = cut_lineage(candidates(docs, id_col, text_col, owner_col, repo_col))
    spans = cut_lineage(judged(cut_lineage(placed(found)), rules))
    keys = ["doc_id", "t0", "t1", "owner", "repo"]
    span = F.struct("start", "kind", "end", "copied")
    n_base = sum(k.base for k in KINDS)
    base = lambda s: s["kind"] < n_base
    made = (
        spans.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(span)).alias("_all"))
        .select(
            *(F.col(k).alias(f"_{k}") for k in keys),
            *(_count_of(i).alias(f"_{k.name}") for i, k in enumerate(KINDS) if k.base),
            _listed(F.filter("_all", base)).alias("_base"), _listed(F.filter("_all", lambda s: base(s) | ~s["copied"])).alias("_spans"),
            F.size(F.filter("_all", lambda s: ~s["copied"])).alias("_live"), F.size(F.filter("_all", lambda s: s["copied"])).alias("_copies"),
        )
    )
    named = {"n_assign": "_assign", "n_access": "_access", "n_hex": "_hex", "base_spans": "_base", "spans": "_spans", "n_live": "_live", "n_copied": "_copies"}
    # Only rows that hold a match are met with their spans, dealt with their hashes as keys.
    holding = found.where(F.size("found") > 0).select(*keys)
    on = [holding[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    met = holding.join(made, on, "left")
    texts = ("base_spans", "spans")
    zero = {new: F.lit("") if new in texts else F.lit(0).cast("long") for new in named}
    full = met.select("doc_id", *(F.coalesce(F.col(old) if new in texts else F.col(old).cast("long"), zero[new]).alias(new) for new, old in named.items()))
    return full.unionByName(found.where(F.size("found") == 0).select("doc_id", *(value.alias(new) for new, value in zero.items())))
