"""Secret scan with corpus-wide ownership frequency.

Patterns find candidate credentials in every whole text.  Each candidate's hash is counted over the whole
corpus by distinct owners and distinct repositories: a value that many owners share is a copied example,
one that stays with few owners looks live.

A value is an example if ``example_owners`` owners have it, or if more than one owner has it and together they have it
in ``example_repos`` repositories; however many repositories of one owner hold a value, it is that owner's.

Base kinds (assign, access, hex) always stay in the result.  Other kinds (pem, provider, jwt, url) are
added only where the ownership count calls the value live.

Positions are code points, ends exclusive.  They are running sums of the lengths of matches and of the pieces between
them, taken block by block, so a text with very many matches costs little more for each; no text is cut off.

Edge cases: a null text counts as empty and has no spans; a null owner is an owner of its own; repeated rows
are separate rows of one owner; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hot, whole_text

# kind, cheap guard (SQL on t), pattern, group of the secret value, least length of that group
BASE_KINDS = [
    (
        "assign",
        r"t rlike '(?i)(password|passwd|secret|token|api_?key)'",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", "contains(t, 'AKIA')", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", "t rlike '[0-9a-f]{24}'", r"[0-9a-f]{24,}", 0, 24),
]
EXTRA_KINDS = [
    (
        "pem",
        "contains(t, '-----BEGIN')",
        # All up to the end marker; a key without one, its header lines and what looks like its body.
        r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+(?=-----END [A-Z ]*PRIVATE KEY-----)"
        r"|(?:\s*+[A-Z][A-Za-z0-9]*+-[A-Za-z0-9-]++:[^\n]*+)*+[A-Za-z0-9+/=\s]*+)",
        0,
        40,
    ),
    (
        "provider",
        "contains(t, 'gh') or contains(t, 'xox') or contains(t, 'AIza') or contains(t, 'k_live_')",
        r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[rs]k_live_[A-Za-z0-9]{16,}",
        0,
        14,
    ),
    ("jwt", "contains(t, 'eyJ')", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("url", "contains(t, '://')", r"://[^\s:@/]++:([^\s:@/]{6,}+)@", 1, 6),
]
KINDS = [k[0] for k in BASE_KINDS + EXTRA_KINDS]
#: A value with so many distinct owners, or more, is an example.
EXAMPLE_OWNERS = 3
#: A value of more than one owner in so many distinct repositories, or more, is an example.
EXAMPLE_REPOS = 4
#: Matches whose running sums are taken in one go.
_BLOCK = 128

_SPAN = "struct<s:int,r:int,e:int,v:string>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _spans(rank: int, guard: str, pattern: str, group: int, least: int) -> str:
    """SQL for the spans of one kind: lengths of matches and of the pieces before them give the offsets."""
    p = _quoted(pattern)
    whole, value = f"regexp_extract_all(t, {p}, 0)", f"regexp_extract_all(t, {p}, {group})"
    # (characters before the match and after the last one, characters of the match, of its value, digest of the value)
    matches = f"""zip_with(
        arrays_zip({whole}, {value}), split(t, {p}, -1),
        (x, before) -> struct(char_length(before) as b, char_length(x.`0`) as w, char_length(x.`1`) as n, sha2(x.`1`, 256) as v))"""
    # The last piece of the split follows the last match; it pairs with none.
    blocks = f"""transform(
        sequence(0, (size(m) - 2) div {_BLOCK}), k -> slice(m, k * {_BLOCK} + 1, least({_BLOCK}, size(m) - 1 - k * {_BLOCK})))"""
    total = "aggregate(k, 0, (a, x) -> a + x.b + x.w)"
    offsets = f"""aggregate(
        transform(blocks, k -> {total}), struct(0 as at, cast(array() as array<int>) as out),
        (a, n) -> struct(a.at + n as at, concat(a.out, array(a.at)) as out), a -> a.out)"""
    end = "acc.at + x.b + x.w"
    span = f"named_struct('s', acc.at + x.b, 'r', {rank}, 'e', {end}, 'v', x.v)"
    walked = f"""aggregate(
        k, struct(o as at, cast(array() as array<{_SPAN}>) as out),
        (acc, x) -> struct({end} as at, if(x.n >= {least}, concat(acc.out, array({span})), acc.out) as out), acc -> acc.out)"""
    # transform(array(x), name -> ...)[0] gives x a name.
    found = f"""transform(array({matches}), m -> if(size(m) < 2, cast(array() as array<{_SPAN}>),
        transform(array({blocks}), blocks -> flatten(zip_with(blocks, {offsets}, (k, o) -> {walked})))[0]))[0]"""
    return f"case when {guard} then {found} else cast(array() as array<{_SPAN}>) end"


def candidate_spans(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """Rows (row_id, id, owner, repo, spans) with every candidate of all kinds, in order of start and kind."""
    base = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("_id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"),
        whole_text(text_col).alias("t"),
    )
    found = [F.expr(_spans(i, *kind[1:])) for i, kind in enumerate(BASE_KINDS + EXTRA_KINDS)]
    return base.select("row_id", "_id", "owner", "repo", F.array_sort(F.concat(*found)).alias("spans"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, n_owners, n_repos, n_uses) over the whole corpus, combined before each shuffle."""
    used = candidates.groupBy("v", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    of_owner = used.groupBy("v", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return of_owner.groupBy("v").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_uses")
    )


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "source",
    example_owners: int = EXAMPLE_OWNERS,
    example_repos: int = EXAMPLE_REPOS,
) -> DataFrame:
    """One row per document: id and spans, an array of (start, end, kind, value_hash, n_owners, n_repos, n_uses, live)."""
    scratch = Scratch(docs.sparkSession, "secrets")
    spine = scratch.put(candidate_spans(docs, id_col, text_col, owner_col, repo_col), "candidates")
    each = spine.filter(F.size("spans") > 0).select(
        "row_id", "owner", "repo", F.posexplode("spans").alias("i", "x")
    ).select("row_id", "owner", "repo", "i", "x.*")
    each = scratch.put(each, "each")
    counts = scratch.put(ownership(each.select("v", "owner", "repo")), "owners")
    copied = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= example_repos))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("r") + 1)
    judged = (
        join_hot(each, counts, ["v"])
        .withColumn("live", ~copied)
        .filter((F.col("r") < len(BASE_KINDS)) | F.col("live"))
        .groupBy("row_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "i", F.col("s").alias("start"), F.col("e").alias("end"), kind.alias("kind"),
                        F.col("v").alias("value_hash"), "n_owners", "n_repos", "n_uses", "live",
                    )
                )
            ).alias("found")
        )
    )
    return spine.select("row_id", "_id").join(judged, "row_id", "left").select(
        F.col("_id").alias(id_col), F.expr("coalesce(found, array())").alias("spans")
    )


def span_text(spans: str | Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
