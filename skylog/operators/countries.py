"""Country reference data: file scan, entity table, callsign lookup.

Several releases of the country file can be scanned in one job (column ``release``); a lookup
uses one :class:`Countries` dimension. Each distinct call is taken apart once into ranked candidate keys; one equi-join
finds those that are listed, and the best of each role decides. The plan is the same for any size of the
reference data: Spark chooses the join from the sizes it finds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import CONTINENTS
from ..functions.text import WS, strip

# Entities that count for another list only, and the primary prefix of the entity
# they belong to; entity names that differ from the file's.
PARENT_PREFIX = {"4U1V": "OE", "GM/s": "GM", "IG9": "I", "IT9": "I", "JW/b": "JW", "TA1": "TA"}
ENTITY_NAME = {"TA": "Turkey"}
# Call suffixes that are no location, and those without any entity.
MODIFIER = r"^(?:[0-9]+|.|FD|FF|LH|LS|LT|YL|[A-Z]{3,})\z"
NO_ENTITY = ["MM", "AM"]
MAX_CALL = 64
# Order of an entry in one number: file, line, place in the line. The format's lines have some 80 characters.
LINE_BITS, FILE_BITS = 22, 52
_DOUBLED = MODIFIER.replace("{", "{{").replace("}", "}}")  # within SQL with parameters

_LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
_ENTRY = (
    r"^(=?)([A-Z0-9/]+)"
    r"((?:\([0-9]+\)|\[[0-9]+\]|<[^<>]*>|\{[A-Z]*\}|~[^~]*~)*)\z"
)
_FLOAT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_PAYLOAD = "cq_zone itu_zone continent lat lon utc_offset".split()


def _number(text: Column, kind: str) -> Column:
    clean = strip(text)
    pattern = _FLOAT if kind == "double" else r"^[+-]?[0-9]+\z"
    return F.when(clean.rlike(pattern), clean.try_cast(kind))


def _plausible(v: dict[str, Column]) -> Column:
    return F.coalesce(
        v["cq_zone"].between(1, 40)
        & v["itu_zone"].between(1, 90)
        & v["continent"].isin(CONTINENTS)
        & v["lat"].between(-90.0, 90.0)
        & v["lon"].between(-180.0, 180.0)
        & (v["utc_offset"] > -24.0)
        & (v["utc_offset"] < 24.0),
        F.lit(False),
    )


@dataclass
class CountryScan:
    """Tables of one scan: entities, entries (with overrides applied) and warnings."""

    entities: DataFrame
    entries: DataFrame
    warnings: DataFrame


def scan_country_files(files: DataFrame) -> CountryScan:
    """Parse country files given as ``(release, text)``, one row per file.

    Lines are exploded and put back into entities by window functions over
    ``(release, line)``; broken entities and entries are left out with a warning row.
    """
    text = F.regexp_replace("text", r"^\uFEFF", "")
    lines = (
        files.select("release", F.posexplode(F.split(text, _LINE_END)).alias("pos", "raw"))
        .select("release", (F.col("pos") + 1).alias("line"), strip("raw").alias("body"))
        .where((F.col("body") != "") & ~F.startswith(F.col("body"), F.lit("#")))
    )
    in_file = Window.partitionBy("release").orderBy("line")
    is_header = F.contains("body", F.lit(":"))
    parts = F.split("body", ":")

    def part(i: int) -> Column:
        return F.get(parts, F.lit(i))

    prefix = strip(part(7))
    wae = F.startswith(prefix, F.lit("*"))
    header = {
        "name": strip(part(0)),
        "cq_zone": _number(part(1), "int"),
        "itu_zone": _number(part(2), "int"),
        "continent": F.upper(strip(part(3))),
        "lat": _number(part(4), "double"),
        "lon": F.lit(0.0) - _number(part(5), "double"),
        "utc_offset": _number(part(6), "double"),
        "primary_prefix": F.when(wae, strip(F.substring(prefix, F.lit(2), F.length(prefix)))).otherwise(prefix),
        "wae_only": wae,
    }
    sound = (
        (F.size(parts) >= 9)
        & (header["name"] != "")
        & (header["primary_prefix"] != "")
        & _plausible(header)
    )
    rest = F.array_join(F.slice(parts, F.lit(9), F.size(parts)), ":")
    lines = lines.select(
        "release",
        "line",
        is_header.alias("is_header"),
        F.when(is_header & F.coalesce(sound, F.lit(False)), F.struct(
            F.col("line").alias("entity_id"), *[v.alias(k) for k, v in header.items()]
        )).alias("head"),
        F.when(is_header, rest).otherwise(F.col("body")).alias("body"),
    ).withColumn("block", F.sum(F.col("is_header").cast("int")).over(in_file))
    in_block = Window.partitionBy("release", "block").orderBy("line")
    closes = F.contains("body", F.lit(";"))
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.select(
        "*",
        closes.alias("closes"),
        F.first("head").over(in_block).alias("entity"),
        F.coalesce(F.max(closes.cast("int")).over(before), F.lit(0)).alias("closed"),
        F.coalesce(F.lag(closes.cast("int")).over(in_block), F.lit(0)).alias("after_close"),
        F.row_number().over(in_block).alias("nth"),
    ).withColumn("inside", F.col("entity").isNotNull() & (F.col("closed") == 0))
    body = F.split_part("body", F.lit(";"), F.lit(1))
    tokens = (
        placed.where("inside")
        .select("release", "line", "entity", F.posexplode(F.split(body, ",")).alias("pos", "token"))
        .withColumn("token", strip("token"))
        .where("token <> ''")
    )
    entries = _entries(tokens)
    entities = placed.where(F.col("head").isNotNull()).select("release", "head.*")
    # stray text is reported once per stretch that ends with ';'; the rest of a broken entity,
    # up to its ';', is covered by the warning of its header
    after_header = F.col("entity").isNull() & (F.col("block") > 0) & (F.col("nth") == 2)
    stray = (
        ~F.col("inside")
        & ~F.col("is_header")
        & (
            ((F.col("block") == 0) & (F.col("nth") == 1))
            | ((F.col("after_close") == 1) & ~after_header)
        )
    )
    unclosed = (
        placed.where(F.col("entity").isNotNull())
        .groupBy("release", "block")
        .agg(F.max("closes").alias("closed"), F.min("line").alias("line"))
        .where("NOT closed")
        .select("release", "line", F.lit("entity_not_closed").alias("code"), F.lit("").alias("text"))
    )
    warnings = (
        placed.where(F.col("is_header") & F.col("head").isNull())
        .select("release", "line", F.lit("bad_entity").alias("code"), F.lit("").alias("text"))
        .unionByName(
            placed.where(stray).select(
                "release", "line", F.lit("stray_text").alias("code"), F.lit("").alias("text")
            )
        )
        .unionByName(
            entries.where("NOT ok").select(
                "release", "line", F.lit("bad_entry").alias("code"), F.col("token").alias("text")
            )
        )
        .unionByName(unclosed)
    )
    return CountryScan(entities, entries.where("ok").drop("ok", "token"), warnings)


def _entries(tokens: DataFrame) -> DataFrame:
    upper = F.upper("token")
    found = tokens.select(
        "*",
        F.regexp_extract(upper, _ENTRY, 1).alias("mark"),
        F.regexp_extract(upper, _ENTRY, 2).alias("key"),
        F.regexp_extract(upper, _ENTRY, 3).alias("rest"),
    )

    def last(pattern: str) -> Column:
        return F.element_at(
            F.nullif(F.regexp_extract_all("rest", F.lit(pattern), F.lit(1)), F.array().cast("array<string>")),
            -1,
        )

    place = last("<([^<>]*)>")
    given = {
        "cq_zone": (last(r"\(([0-9]+)\)"), lambda t: _number(t, "int")),
        "itu_zone": (last(r"\[([0-9]+)\]"), lambda t: _number(t, "int")),
        "continent": (last(r"\{([A-Z]*)\}"), lambda t: t),
        "lat": (place, lambda t: _number(F.split_part(t, F.lit("/"), F.lit(1)), "double")),
        "lon": (
            place,
            lambda t: F.lit(0.0) - _number(F.regexp_extract(t, "/(.*)", 1), "double"),
        ),
        "utc_offset": (last("~([^~]*)~"), lambda t: _number(t, "double")),
    }
    values = {
        name: F.when(text.isNull(), F.col(f"entity.{name}")).otherwise(read(text))
        for name, (text, read) in given.items()
    }
    return found.select(
        "release",
        "line",
        F.col("entity.entity_id").alias("entity_id"),
        (F.col("line").cast("long") * (1 << LINE_BITS) + F.col("pos")).alias("seq"),
        F.when(F.col("mark") == "=", "E").otherwise("P").alias("kind"),
        "key",
        *[v.alias(k) for k, v in values.items()],
        ((F.col("key") != "") & _plausible(values)).alias("ok"),
        "token",
    )


def one_release(scan: CountryScan) -> CountryScan:
    """The files of a scan as parts of one release, in the order of their numbers in ``release``.

    Every file is parsed by itself; entities and entries get an order over all files, by which the first entry of a key wins.
    """
    part = F.col("release").cast("long")
    entity = (part * (1 << FILE_BITS - LINE_BITS) + F.col("entity_id")).alias("entity_id")

    def joined(table: DataFrame) -> DataFrame:
        order = {"entity_id": entity, "seq": (part * (1 << FILE_BITS) + F.col("seq")).alias("seq"), "release": F.lit(0).alias("release")}
        return table.select(*[order.get(c, F.col(c)) for c in table.columns])

    return CountryScan(joined(scan.entities), joined(scan.entries), scan.warnings)


def scan_codes(lines: DataFrame, together: bool = False) -> DataFrame:
    """Entity codes from country CSV lines ``(release, line, text)``: first good row per prefix.

    ``together`` takes the numbers in ``release`` as parts of one release, 0.
    """
    text = strip("text")
    row = F.from_csv(text, F.lit("prefix string, name string, code string, rest string"))
    code = strip(F.col("row.code"))
    number = F.when(code.rlike(r"^[0-9]+\z"), code.try_cast("int"))
    return (
        lines.where((text != "") & ~F.startswith(text, F.lit("#")))
        .select("release", "line", row.alias("row"))
        .select("release", "line", strip(F.col("row.prefix")).alias("prefix"), number.alias("dxcc"))
        .where((F.col("prefix") != "") & F.col("dxcc").between(1, 999))
        .groupBy(F.lit(0).alias("release") if together else F.col("release"), "prefix")
        .agg(F.min_by("dxcc", F.struct("release", "line")).alias("dxcc"))
    )


def build_entities(entities: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds ``dxcc`` and ``dxcc_name``; entities of the other list take those of their parent."""
    key = F.when(F.col("wae_only"), F.concat(F.lit("*"), "primary_prefix")).otherwise(
        F.col("primary_prefix")
    )
    own = (
        entities.withColumn("prefix", key)
        .join(codes.select("release", "prefix", "dxcc"), ["release", "prefix"], "left")
        .drop("prefix")
    )
    name = F.coalesce(
        *[F.when(F.col("primary_prefix") == k, F.lit(v)) for k, v in ENTITY_NAME.items()],
        F.col("name"),
    )
    main = own.where(~F.col("wae_only")).withColumn("shown", name)
    by_code = (
        main.where("dxcc IS NOT NULL")
        .groupBy("release", "dxcc")
        .agg(F.count("*").alias("n"), F.min_by("shown", "entity_id").alias("code_parent"))
        .where("n = 1")
        .drop("n")
    )
    by_prefix = (
        main.groupBy("release", F.col("primary_prefix").alias("parent_prefix"))
        .agg(
            F.min_by("shown", "entity_id").alias("prefix_parent"),
            F.min_by(F.struct("dxcc"), "entity_id")["dxcc"].alias("prefix_dxcc"),
        )
    )
    parent = F.coalesce(
        *[F.when(F.col("primary_prefix") == k, F.lit(v)) for k, v in PARENT_PREFIX.items()]
    )
    joined = (
        own.withColumn("parent_prefix", F.when(F.col("wae_only"), parent))
        .join(by_code, ["release", "dxcc"], "left")
        .join(by_prefix, ["release", "parent_prefix"], "left")
    )
    inherited = F.coalesce("code_parent", "prefix_parent", "name")
    columns = [c for c in entities.columns]
    return joined.select(
        *columns,
        F.when(F.col("wae_only"), F.coalesce("dxcc", "prefix_dxcc"))
        .otherwise(F.col("dxcc"))
        .alias("dxcc"),
        F.when(F.col("wae_only"), inherited).otherwise(name).alias("dxcc_name"),
    )


@dataclass
class Countries:
    """A lookup dimension."""

    keys: DataFrame  # kind (E: whole call, P: prefix), key, eid
    payload: DataFrame  # eid and the match columns
    longest_prefix: int
    us_eid: int | None


MATCH_FIELDS = (
    "entity name dxcc dxcc_name continent cq_zone itu_zone lat lon utc_offset matched exact"
).split()


def countries(entries: DataFrame, entities: DataFrame) -> Countries:
    """The dimension of one release: first entry per key wins, entity fields attached.

    Runs one small aggregate over the reference data for the longest prefix.
    """
    first = entries.groupBy("kind", "key").agg(
        F.min_by(F.struct("entity_id", *_PAYLOAD), "seq").alias("e"), F.min("seq").alias("eid")
    )
    named = entities.select(
        "entity_id", F.col("primary_prefix").alias("entity"), "name", "dxcc", "dxcc_name"
    )
    rows = first.select("kind", "key", "eid", "e.*").join(named, "entity_id")
    # the United States with its own defaults, for the KG4 rule
    usa = (
        entities.where("primary_prefix = 'K' AND NOT wae_only")
        .groupBy()
        .agg(F.min_by(F.struct("*"), "entity_id").alias("u"))
        .where("u IS NOT NULL")
        .select("u.*")
        .select(
            F.lit("U").alias("kind"),
            F.lit("K").alias("key"),
            F.lit(-1).cast("long").alias("eid"),
            *_PAYLOAD,
            F.col("primary_prefix").alias("entity"),
            "name",
            "dxcc",
            "dxcc_name",
        )
    )
    rows = rows.drop("entity_id").unionByName(usa)
    bounds = rows.agg(
        F.max(F.when(F.col("kind") == "P", F.length("key"))).alias("longest"),
        F.max(F.when(F.col("kind") == "U", F.col("eid"))).alias("us"),
    ).first()
    return Countries(
        keys=rows.where("kind <> 'U'").select("kind", "key", "eid"),
        payload=rows.select(
            "eid", F.col("key").alias("matched"), (F.col("kind") == "E").alias("exact"),
            "entity", "name", "dxcc", "dxcc_name", *_PAYLOAD,
        ),
        longest_prefix=bounds["longest"] or 0,
        us_eid=bounds["us"],
    )


def _prefixes(text: str, role: str, dim: Countries) -> str:
    """SQL for the candidates of all prefixes of ``text``, the longest ranking first."""
    most = f"least(length({text}), {dim.longest_prefix})"
    one = f"named_struct('role', '{role}', 'rank', -n, 'kind', 'P', 'key', left({text}, n))"
    return f"CASE WHEN {most} > 0 THEN transform(sequence(1, {most}), n -> {one}) END"


def _best(wanted: DataFrame, text: str, dim: Countries, roles: str) -> DataFrame:
    """For each ``text`` the entry (``<role>_eid``) and rank (``<role>_rank``) of the best listed candidate of each role."""
    listed = wanted.join(dim.keys, ["kind", "key"])
    found = []
    for role in roles:
        rank = F.when(F.col("role") == role, F.col("rank"))
        found += [F.min_by("eid", rank).alias(f"{role}_eid"), F.min(rank).alias(f"{role}_rank")]
    return listed.groupBy(text).agg(*found)


def longest_prefix(df: DataFrame, text: str, dim: Countries, out: str) -> DataFrame:
    """Adds ``out`` (entry id) and ``out_len`` of the longest listed prefix of column ``text``."""
    texts = df.select(F.col(text).alias("_wanted")).where("_wanted IS NOT NULL").distinct()
    best = _best(texts.select("_wanted", F.expr(f"inline({_prefixes('_wanted', 'a', dim)})")), "_wanted", dim, "a")
    found = df.join(best, F.col(text) == F.col("_wanted"), "left")
    return found.select(*df.columns, F.col("a_eid").alias(out), (-F.coalesce("a_rank", F.lit(0))).alias(f"{out}_len"))


def clean_call(call: Column | str) -> Column:
    """Upper-case call without any white space, NULL when it cannot be a call."""
    text = F.upper(F.regexp_replace(call, f"[{WS}]+", ""))
    return F.when((F.length(text) <= MAX_CALL) & text.rlike(r"^[A-Z0-9/]*[A-Z0-9][A-Z0-9/]*\z"), text)


def lookup(df: DataFrame, call: Column | str, dim: Countries, out: str = "match") -> DataFrame:
    """Adds struct ``out`` with the country match of a call, NULL when there is none.

    Precedence: an exact entry of the whole call, then with trailing modifiers dropped one by
    one, then with all modifiers dropped; ``/MM`` and ``/AM`` have no entity; then the longest
    prefix of the location part, the exact entry of the home call and its longest prefix.
    """
    text = clean_call(F.col(call) if isinstance(call, str) else call)
    log = df.withColumn("_text", text)
    found = log.join(matches(log.select("_text"), dim), "_text", "left")
    return found.select(*df.columns, F.col("match").alias(out))


def matches(calls: DataFrame, dim: Countries) -> DataFrame:
    """``_text, match`` of the distinct cleaned calls that have a country."""
    us = "NULL" if dim.us_eid is None else str(dim.us_eid)
    fields_ = ", ".join(f"'{f}', m.{f}" for f in MATCH_FIELDS)
    taken = "named_struct('role', '{}', 'rank', {}, 'kind', 'E', 'key', {})".format
    cut = taken("x", "-n", "array_join(slice(_parts, 1, n), '/')")
    bare = taken("x", "0", "array_join(_kept, '/')")
    homes = [taken(role, "0", part) for role, part in (("c", "_first"), ("d", "_second"))]
    wanted = calls.sparkSession.sql(rf"""
    WITH parts AS (
      SELECT *, CASE WHEN contains(_text, '/') THEN filter(split(_text, '/'), p -> p <> '')
        ELSE array(_text) END AS _parts
      FROM {{calls}}),
    kept AS (
      SELECT *,
        CASE WHEN size(_parts) = 1 THEN _parts ELSE concat(slice(_parts, 1, 1), filter(
          slice(_parts, 2, {MAX_CALL}), p -> NOT p RLIKE r'{_DOUBLED}')) END AS _kept,
        CASE WHEN size(_parts) = 1 THEN 1 ELSE array_max(transform(_parts, (p, i) ->
          CASE WHEN i = 0 OR NOT p RLIKE r'{_DOUBLED}' THEN i + 1 END)) END AS _trimmed
      FROM parts),
    ends AS (SELECT *, get(_kept, 0) AS _first, get(_kept, 1) AS _second FROM kept)
    SELECT _text, inline(concat(
      transform(sequence(_trimmed, size(_parts)), n -> {cut}),
      CASE WHEN size(_kept) <> _trimmed THEN array({bare}) ELSE array() END,
      coalesce({_prefixes('_first', 'a', dim)}, array()),
      coalesce({_prefixes('_second', 'b', dim)}, array()),
      CASE WHEN _second IS NOT NULL THEN array({', '.join(homes)}) ELSE array() END))
    FROM ends""", calls=calls.where("_text IS NOT NULL").distinct())
    # the best candidates decide: the shorter part is the location, the other one is the home call
    return calls.sparkSession.sql(rf"""
    WITH parts AS (
      SELECT *, filter(split(_text, '/'), p -> p <> '') AS _parts FROM {{best}}),
    kept AS (
      SELECT *, concat(slice(_parts, 1, 1), filter(
          slice(_parts, 2, {MAX_CALL}), p -> NOT p RLIKE r'{_DOUBLED}')) AS _kept,
        exists(slice(_parts, 2, {MAX_CALL}), p -> p IN ('MM', 'AM')) AS _adrift
      FROM parts),
    sides AS (
      SELECT *, get(_kept, 0) AS _first, get(_kept, 1) AS _second,
        coalesce(length(get(_kept, 1)) < length(get(_kept, 0)) OR length(get(_kept, 1)) = length(get(_kept, 0))
          AND coalesce(-b_rank, 0) > coalesce(-a_rank, 0), true) AS _first_is_home
      FROM kept),
    homes AS (
      SELECT *, CASE WHEN _first_is_home THEN _first ELSE _second END AS _home,
        CASE WHEN _second IS NULL THEN NULL WHEN _first_is_home THEN b_eid ELSE a_eid END AS _location,
        CASE WHEN _first_is_home THEN c_eid ELSE d_eid END AS _home_exact,
        CASE WHEN _first_is_home THEN a_eid ELSE b_eid END AS _home_p,
        -CASE WHEN _first_is_home THEN a_rank ELSE b_rank END AS _home_len
      FROM sides),
    found AS (
      SELECT _text, CASE
        WHEN x_eid IS NOT NULL THEN x_eid
        WHEN _adrift OR _home RLIKE r'^[A-Z]+\z' THEN NULL
        ELSE coalesce(_location, _home_exact, CASE WHEN _home_len = 3
          AND _home RLIKE r'^KG4([A-Z]|[A-Z]{{{{3}}}})\z' THEN CAST({us} AS BIGINT) END, _home_p)
        END AS _eid
      FROM homes)
    SELECT l._text, named_struct({fields_}) AS match
    FROM found l JOIN {{payload}} m ON l._eid = m.eid
    """, best=_best(wanted, "_text", dim, "xabcd"), payload=dim.payload)
