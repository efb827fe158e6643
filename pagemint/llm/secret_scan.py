"""Secret scans, native: candidates by pattern, judged by how many repositories and owners hold them.

A value that many owners or many repositories hold is an example that was copied about; one that a single owner holds, in a
few repositories, may be live. Candidates
of all documents are hashed and counted by hash, owner and repository (each step combines before it shuffles, so a value
in a third of all rows costs a row for each task), and the counts go back to the candidates by a plain equi-join whose
hot keys Spark splits. Texts are read once and never shuffled: what is shuffled are the narrow candidate rows, which are
written once to the shared folder.

Base kinds: assign (a name like password or token, : or =, and a value of 6 or more characters), access (AKIA key ids of
20 or more), hex (24 or more). The method's own kind, opaque: other tokens of 32 or more characters that mix cases and
digits, kept only where the value looks live; private keys (pem) likewise. A private key's value is its body without line
ends, so keys are told apart; a header with a body of less than 32 characters is no key.

Defined cases: null texts count as empty; null owners and repositories count as one owner and one repository each;
repeated rows each keep their result; empty tables give empty results; texts are scanned whole; only the id, text, owner
and repository columns are used, whatever others there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemint.llm import spans as S
from pagemint.llm.common import stored

KINDS = ["assign", "access", "hex", "opaque", "pem"]
BASE = 3
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?:(?<![0-9a-f])|\G)[0-9a-f]{24,}+",
    "opaque": r"(?:(?<![A-Za-z0-9+/_-])|\G)(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{32,}+",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----\s*((?:[A-Za-z-]+: [^\n]*\n\s*)*[A-Za-z0-9+/=\s]*)",
}
#: Kinds whose value is a group of the pattern.
GROUPS = {"assign": 2, "pem": 1}
KEY_BODY = 32


def found(text: Column) -> Column:
    """Candidate spans of all kinds: array<struct<kind, start, end, value>>, value being the secret itself."""
    gates = {
        "assign": (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & F.rlike(text, F.lit(PATTERNS["assign"])),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": F.rlike(text, F.lit(r"[0-9a-f]{24}")),
        "opaque": F.rlike(text, F.lit(r"[A-Za-z0-9+/_-]{32}")),
        "pem": F.contains(text, F.lit("PRIVATE KEY-----")),
    }
    each = []
    for i, k in enumerate(KINDS):
        spans = S.matches(text, PATTERNS[k], i, GROUPS.get(k, 0))
        if k == "assign":
            spans = F.filter(spans, lambda s: F.length(s["value"]) >= 6)
        elif k == "pem":
            body = lambda s: F.regexp_replace(s["value"], r"\s", "")
            spans = F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"], body(s).alias("value")))
            spans = F.filter(spans, lambda s: F.length(s["value"]) >= KEY_BODY)
        each.append(F.when(gates[k], spans).otherwise(S.none()))
    return S.by_start(F.concat(*each))


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    owner: str = "owner",
    repository: str = "repository",
    max_owners: int = 1,
    max_repositories: int = 3,
) -> DataFrame:
    """One row for each row of ``docs``: its id, base and all kept spans, with how many are live-looking or copied.

    Columns: the id, base (array of spans), spans (base and the method's own), live (spans whose value at most ``max_owners``
    owners hold, in at most ``max_repositories`` repositories), copied (the others among the candidates).
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    candidates = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(f"`{doc_id}`").alias("id"),
            named(owner).alias("owner"),
            named(repository).alias("repository"),
            F.transform(
                found(whole),
                lambda s: F.struct(s["kind"], s["start"], s["end"], F.md5(s["value"].cast("binary")).alias("value")),
            ).alias("spans"),
        ),
        "secret-candidates",
    )
    each = candidates.select("row", "owner", "repository", F.explode("spans").alias("s")).select(
        "row", "owner", "repository", "s", F.col("s.value").alias("value")
    )
    # stored: Spark splits the hot keys of a join only where neither side is an aggregate on the same key
    owners = stored(
        each.groupBy("value", "owner", "repository")
        .agg(F.count("*").alias("places"))
        .groupBy("value", "owner")
        .agg(F.count("*").alias("repositories"), F.sum("places").alias("places"))
        .groupBy("value")
        .agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("places").alias("places")),
        "secret-owners",
    )
    judged = (
        each.join(owners, "value")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("s.start", "s.kind", "s.end", "owners", "repositories"))).alias("judged"))
    )
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    few = lambda s: (s["owners"] <= max_owners) & (s["repositories"] <= max_repositories)
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,owners:bigint,repositories:bigint>>)")
    all_spans = F.coalesce("judged", empty)
    return candidates.select("row", "id").join(judged, "row", "left").select(
        F.col("id").alias(doc_id),
        F.transform(F.filter(all_spans, lambda s: s["kind"] < BASE), bare).alias("base"),
        F.transform(F.filter(all_spans, lambda s: (s["kind"] < BASE) | few(s)), bare).alias("spans"),
        F.transform(F.filter(all_spans, few), bare).alias("live"),
        F.transform(F.filter(all_spans, lambda s: ~few(s)), bare).alias("copied"),
    )
