"""Secret scans with linked multipart credentials, in DataFrame functions only.

Matches of each kind come from one ``regexp_extract_all`` and one ``split`` by the same
pattern; a running sum of the lengths of gaps and matches gives their places in
code points.  Base kinds are reported as they are.  Weak candidates (account
names, loosely named secrets, endpoints) are reported only where complementary
parts stand within the same scope: one block of lines (blocks are set apart by an empty
line), and at most SCOPE code points between their starts.  That interval join is an
equi-join on (row, block, bin): each bin keeps the first and the last place of each role,
which is enough, as the nearest part of a role in the bin before is its last, in the
bin behind its first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, with_row_id


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _named(words: list[str], value: str) -> str:
    return "(" + "|".join(map(any_case, words)) + r""")["']?\x20*[:=]\x20*["']?(""" + value + ")"


#: kind -> (pattern, group whose length counts, least length, role)
BASE = {
    "assign": (_named(["password", "passwd", "secret", "token", "api_?key"], "[A-Za-z0-9+/_.=-]+"), 2, 8, "secret"),
    "access": ("AKIA[A-Z0-9]+", 0, 16, "access"),
    "hex": ("[0-9a-f]+", 0, 32, "secret"),
}
WEAK = {
    "weak_access": (_named(["access_?key_?id", "client_?id", "account_?id", "username", "user", "login"], "[A-Za-z0-9@._-]+"), 2, 4, "access"),
    "weak_secret": (_named(["pwd", "pass", "auth", "credential", "private_?key", "access_?key"], "[A-Za-z0-9+/_.=-]+"), 2, 8, "secret"),
    "endpoint": (r"""[a-z][a-z0-9+]+://[^\x20\x09-\x0D"'<>]+""", 0, 10, "endpoint"),
}
KINDS = BASE | WEAK
ORDER = {k: i for i, k in enumerate(KINDS)}
ROLES = ("access", "secret", "endpoint")
#: Parts of one block of lines that start at most this many code points apart belong to one scope.
SCOPE = 400
MASK = "[SECRET]"


def _runs(kind: str) -> str:
    """The pattern that is searched for: runs of hex digits that are too short are
    left out at once, which changes no match that counts."""
    return "[0-9a-f]{32,}" if kind == "hex" else KINDS[kind][0]


def possible(text: Column, kind: str) -> Column:
    """A cheap condition without which the kind cannot match."""
    if kind == "access":
        return text.contains("AKIA")
    if kind == "hex":
        return text.rlike("[0-9a-f]{32}")
    if kind == "endpoint":
        return text.contains("://")
    return (text.contains("=") | text.contains(":")) & text.rlike(KINDS[kind][0])


def _empty_lines(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit("\n\n"), F.lit("")))) / 2).cast("int")


def _matches(text: Column, kind: str) -> Column:
    pattern, group, least, _ = KINDS[kind]
    run = F.lit(_runs(kind))
    value = F.regexp_extract_all(text, run, F.lit(group))
    zipped = F.arrays_zip(F.regexp_extract_all(text, run, F.lit(0)).alias("m"), value.alias("v"), F.split(text, _runs(kind), -1).alias("gap"))
    one = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), _empty_lines(x["gap"]).alias("blank"), F.length(x["m"]).alias("len"), (F.length(x["v"]) >= least).alias("counts"))
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,blank:int,len:int,counts:boolean>>")
    return F.when(possible(text, kind), F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), one)).otherwise(none)


def spans_of(rows: DataFrame) -> DataFrame:
    """``__row, kind, start, end, block`` (long, code points, end exclusive) from rows with ``__row`` and ``parts``."""
    part = rows.select("__row", F.explode("parts").alias("p")).select("__row", "p.*")
    ran = Window.partitionBy("__row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.col("len")).cast("long")).over(ran)
    placed = part.withColumns({"end": end, "block": F.sum(F.col("blank").cast("long")).over(ran)})
    return placed.where("counts").select("__row", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "block")


def _role_map(column: Column, value=lambda k: KINDS[k][3]) -> Column:
    out = F.lit(None)
    for k in KINDS:
        out = F.when(column == k, F.lit(value(k))).otherwise(out)
    return out


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates of ``spans`` that have their complementary parts in scope:
    an account needs a secret, a secret an account or an endpoint, an endpoint both."""
    placed = spans.withColumns({"role": _role_map(F.col("kind")), "bin": F.floor(F.col("start") / scope)})
    ends = [f(F.when(F.col("role") == r, F.col("start"))).alias(f"{n}_{r}") for r in ROLES for n, f in (("first", F.min), ("last", F.max))]
    bins = placed.groupBy("__row", "block", "bin").agg(*ends)
    weak = placed.where(F.col("kind").isin(*WEAK)).withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    near = lambda r: F.coalesce(F.bool_or((F.abs(F.col(f"first_{r}") - F.col("start")) <= scope) | (F.abs(F.col(f"last_{r}") - F.col("start")) <= scope)), F.lit(False))
    judged = weak.join(bins, ["__row", "block", "bin"]).groupBy("__row", "kind", "role", "start", "end", "block").agg(*(near(r).alias(f"has_{r}") for r in ROLES))
    ok = F.when(F.col("role") == "access", F.col("has_secret")).when(F.col("role") == "secret", F.col("has_access") | F.col("has_endpoint")).otherwise(F.col("has_access") & F.col("has_secret"))
    return judged.where(ok).select("__row", "kind", "start", "end")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``key`` and ``spans`` (array of start, no, kind, end; sorted) of every row.

    Null text counts as empty, an empty table gives no rows.  Null and repeated keys are kept, as rows are told
    apart by a number of their own; other columns are not looked at.  A very long text is searched to its
    end; only its candidates travel.  An empty line (two line feeds in a row; not a line of blanks, nor CR LF) ends a scope.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = staged(with_row_id(docs.select(F.col(key).alias("__key"), F.concat(*(_matches(t, k) for k in KINDS)).alias("parts"))), "parts")
    found = staged(spans_of(rows.where(F.size("parts") > 0)), "spans")
    reported = found.where(F.col("kind").isin(*BASE)).drop("block").unionByName(linked(found, scope))
    no = _role_map(F.col("kind"), lambda k: ORDER[k])
    listed = reported.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", no.alias("no"), "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,no:int,kind:string,end:bigint>>")
    return rows.select("__row", "__key").join(listed, "__row", "left").select(F.col("__key").alias(key), F.coalesce("spans", none).alias("spans"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kinds) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def masked(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every reported span replaced by ``mask``; all rows and columns stay.

    Rows without any candidate pass by without a shuffle.  Overlapping spans
    become one mask.  Null text stays null; repeated rows stay, and columns of any name.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    candidate = F.lit(False)
    for k in KINDS:
        candidate = candidate | possible(t, k)
    hit = staged(with_row_id(docs.where(candidate).select(F.struct(*docs.columns).alias("row"), F.col(text).alias("t"))), "candidates")
    spans = scan(hit, "__row", "t").where(F.size("spans") > 0).select(F.col("__row"), F.explode("spans").alias("s")).select("__row", "s.start", "s.end")
    w = Window.partitionBy("__row").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = spans.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = joined.groupBy("__row", "block").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    listed = blocks.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    s = F.col("spans")
    prior = lambda i: F.coalesce(F.get(s, i - 1)["end"], F.lit(0))
    kept = F.transform(s, lambda x, i: F.concat(F.substring(F.col("t"), (prior(i) + 1).cast("int"), (x["start"] - prior(i)).cast("int")), F.lit(mask)))
    tail = F.substring(F.col("t"), (F.element_at(s, -1)["end"] + 1).cast("int"), F.length("t"))
    new = F.when(s.isNull(), F.col("t")).otherwise(F.concat(F.array_join(kept, ""), tail))
    changed = hit.join(listed, "__row", "left").select(*((new if c == text else F.col("row")[c]).alias(c) for c in docs.columns))
    return docs.where(~candidate).unionByName(changed)


def sql(scope: int = SCOPE) -> str:
    """The result of query op3 for DuckDB."""
    one = """
      SELECT doc_id, '{kind}' AS kind, m, v, gap, {least} AS least FROM (
        SELECT doc_id, unnest(regexp_extract_all(t, '{p}', 0)) AS m, unnest(regexp_extract_all(t, '{p}', {group})) AS v,
               unnest(list_slice(regexp_split_to_array(t, '{p}'), 1, len(regexp_extract_all(t, '{p}', 0)))) AS gap
        FROM docs)"""
    parts = " UNION ALL ".join(one.format(kind=k, least=least, group=group, p=_runs(k).replace("'", "''")) for k, (_, group, least, _) in KINDS.items())
    roles = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v[3]}'" for k, v in KINDS.items()) + " END"
    nos = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in ORDER.items()) + " END"
    base, weak = (", ".join(f"'{k}'" for k in x) for x in (BASE, WEAK))
    near = lambda r: f"EXISTS (SELECT 1 FROM spans o WHERE o.doc_id = w.doc_id AND o.role = '{r}' AND o.block = w.block AND abs(o.start - w.start) <= {scope})"
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    parts AS (SELECT *, row_number() OVER () AS n FROM ({parts})),
    placed AS (SELECT doc_id, kind, length(v) >= least AS counts, length(m) AS len,
        sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY n ROWS UNBOUNDED PRECEDING) AS stop,
        sum((length(gap) - length(replace(gap, chr(10) || chr(10), ''))) // 2) OVER (PARTITION BY doc_id, kind ORDER BY n ROWS UNBOUNDED PRECEDING) AS block FROM parts),
    spans AS (SELECT doc_id, kind, {roles} AS role, {nos} AS no, CAST(stop - len AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, block FROM placed WHERE counts),
    reported AS (SELECT * FROM spans WHERE kind IN ({base}) UNION ALL
        SELECT * FROM spans w WHERE kind IN ({weak}) AND CASE role WHEN 'access' THEN {near("secret")}
            WHEN 'secret' THEN {near("access")} OR {near("endpoint")} ELSE {near("access")} AND {near("secret")} END),
    lists AS (SELECT doc_id, count_if(kind = 'assign') AS a, count_if(kind = 'access') AS b, count_if(kind = 'hex') AS c,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) FILTER (WHERE kind IN ({base})) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) AS every FROM reported GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
    FROM docs d LEFT JOIN lists USING (doc_id)"""
