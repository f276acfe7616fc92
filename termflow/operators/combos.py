"""Multi-leg symbols to canonical legs, once per distinct key, as column expressions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from termflow.functions.calendar import code_month, month_code
from termflow.operators import ingest
from termflow.session import materialize

# Leg grammars, marker words and the one root whose packs are built.
LEG = r"^([FGHJKMNQUVXZ])(\d{1,2})$"
ROOTED_LEG = r"^([A-Z0-9]{1,4})([FGHJKMNQUVXZ])(\d{1,2})$"
MARKERS = {"BF": "butterfly", "BB": "butterfly3", "CF": "condor", "DF": "condor4", "AB": "average", "SB": "pack", "C1": "crack"}
BUCKET = {"plain": "spread", "labeled": "spread", "crack": "spread", "butterfly": "butterfly", "butterfly3": "butterfly",
          "condor": "condor", "condor4": "condor", "average": "average", "pack": "pack"}
PACK_ROOT = "SR3"
KEYS = ("asset", "root", "raw_symbol", "maturity_year", "maturity_month")
LEG_NAMES = {"spread": ("near", "far"), "butterfly": ("near", "mid", "far"), "condor": ("near", "mid1", "mid2", "far"),
             "average": ("anchor",), "pack": ("near", "far")}


# One pattern per multi-part grammar.
LABELED = r"^([^:]*):(\S*) ([^-]*)-([^-]*)$"
CRACK = r":C1 ([^- ]+)(?: ([^-]*))?- *(\S+) (.*)$"
PACK = r":SB (\S+) (.*)$"
AVERAGE = r":AB (\d+)Y (.*)$"


def classify(raw: Column) -> Column:
    marker = F.regexp_extract(raw, r"^[^:]*:([^ ]*)", 1)
    e = F.when(raw.startswith("UD:"), "user_defined").when(~raw.contains(":"), "plain")
    for m, kind in MARKERS.items():
        e = e.when(marker == m, kind)
    return e.otherwise("labeled")


def leg_tokens(raw: Column, kind: Column, root: Column) -> Column:
    """Array of (root, token, forced): one entry per leg, NULL when the shape does not fit.

    `forced` marks a leg that borrows another leg's month but keeps its own root.
    """
    def tok(r: Column, t: Column, forced: bool | Column = False) -> Column:
        return F.struct(r.alias("root"), F.trim(t).alias("tok"), (F.lit(forced) if isinstance(forced, bool) else forced).alias("forced"))

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(raw, pattern, i)

    def dash(text: Column, n: int) -> Column:
        parts = F.split(text, "-")
        return F.when(F.size(parts) == n, F.transform(parts, lambda x: tok(root, x)))

    def fixed(mark: str, n: int) -> Column:
        t = F.trim(group(f":{mark} (.*)$", 1))
        return F.when(F.length(t) == 2 * n, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: tok(root, F.substr(t, 2 * i + 1, F.lit(2)))))

    own = group(CRACK, 2)
    crack = F.array(tok(group(CRACK, 1), F.when(F.trim(own) != "", own).otherwise(group(CRACK, 4)), F.trim(own) == ""), tok(group(CRACK, 3), group(CRACK, 4)))
    return (F.when(kind == "plain", dash(raw, 2))
            .when((kind == "labeled") & raw.rlike(LABELED), F.array(tok(group(LABELED, 1), group(LABELED, 3)), tok(group(LABELED, 2), group(LABELED, 4))))
            .when((kind == "crack") & raw.rlike(CRACK), crack)
            .when(kind == "butterfly", dash(group(":BF (.*)$", 1), 3)).when(kind == "butterfly3", dash(group(":BB (.*)$", 1), 3))
            .when(kind == "condor", fixed("CF", 4)).when(kind == "condor4", fixed("DF", 4))
            .when((kind == "average") & raw.rlike(AVERAGE), F.array(tok(root, group(AVERAGE, 2))))
            .when((kind == "pack") & raw.rlike(PACK) & (root == PACK_ROOT), dash(group(PACK, 2), 2)))


def leg_parts(t: Column) -> Column:
    """Root, month letter and year digits of one token; NULL letter when the token is no leg."""
    tok = t["tok"]
    bare, full = tok.rlike(LEG), tok.rlike(ROOTED_LEG)
    return F.struct(
        F.when(bare | t["forced"], t["root"]).when(full, F.regexp_extract(tok, ROOTED_LEG, 1)).alias("root"),
        F.when(bare, F.regexp_extract(tok, LEG, 1)).when(full, F.regexp_extract(tok, ROOTED_LEG, 2)).alias("code"),
        F.when(bare, F.regexp_extract(tok, LEG, 2)).when(full, F.regexp_extract(tok, ROOTED_LEG, 3)).alias("digits"))


def leg_years(legs: Column) -> Column:
    """Absolute year per leg, NULL where any can't be told: two digits are absolute, one digit is an offset from the leg whose
    month is the instrument's own; among several such legs the tightest span wins, the first on ties."""
    def years(anchor: Column | None) -> Column:
        def one(x: Column) -> Column:
            d, y = x["digits"].cast("int"), F.when(F.length(x["digits"]) == 2, x["digits"].cast("int") + 2000)
            return y if anchor is None else y.otherwise(F.col("maturity_year") + F.pmod(d - anchor, F.lit(10)))
        return F.transform(legs, one)

    def choice(a: Column) -> Column:
        y = years(a["digit"])
        return F.struct((F.array_max(y) - F.array_min(y)).alias("span"), a["pos"].alias("pos"), y.alias("years"))

    own = F.transform(legs, lambda x, i: F.struct(i.alias("pos"), F.when((F.length(x["digits"]) == 1) & (x["code"] == month_code("maturity_month")), x["digits"].cast("int")).alias("digit")))
    anchors = F.filter(own, lambda a: a["digit"].isNotNull())
    best = F.when(F.size(anchors) > 0, F.array_min(F.transform(anchors, choice))["years"]).otherwise(years(None))
    return F.when(~F.exists(best, lambda y: y.isNull()), best)


def resolve_keys(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct (asset, root, raw_symbol, maturity) keys to bucket, legs or a reject reason, as one projection without a join.

    roots(leg_root, leg_exchange) is the tracked product list, held as one map; a leg outside it rejects the key.
    """
    raw, key = F.col("raw_symbol"), list(KEYS)
    known = roots.groupBy("leg_root").agg(F.max("leg_exchange").alias("leg_exchange")).agg(F.map_from_entries(F.collect_list(F.struct("leg_root", "leg_exchange"))).alias("m")).scalar()
    k = keys.select(*key).distinct().withColumn("combo_type", classify(raw)).withColumn("__known", known)
    k = k.withColumn("__legs", F.transform(leg_tokens(raw, F.col("combo_type"), F.col("root")), leg_parts))
    # a key with any unreadable token has no legs at all
    k = k.withColumn("__legs", F.when((F.size("__legs") > 0) & ~F.exists("__legs", lambda x: x["code"].isNull()), F.col("__legs")))
    k = k.withColumn("__years", leg_years(F.col("__legs")))

    def item(x: Column, i: Column) -> Column:
        year, code = F.get("__years", i), x["code"]
        symbol = F.concat(x["root"], code, F.lpad((year % 100).cast("string"), 2, "0"), F.lit("."), F.try_element_at("__known", x["root"]))
        return F.struct((year * 12 + code_month(code)).alias("m"), i.alias("pos"), x["root"].alias("root"), symbol.alias("contract_symbol"), year.alias("expiry_year"), code.alias("expiry_code"))

    k = k.withColumn("out", F.when(F.col("__years").isNotNull(), F.array_sort(F.transform("__legs", item))))
    spread_like = F.col("combo_type").isin("plain", "labeled", "crack")
    reject = (F.when(F.col("combo_type") == "user_defined", "user_defined")
              .when(F.col("__legs").isNull(), F.when(spread_like, "not_2_legs").otherwise("leg_parse_fail"))
              .when(F.col("out").isNull(), "leg_parse_fail").when(F.exists("out", lambda x: x["contract_symbol"].isNull()), "unknown_root"))
    bucket = F.lit(None)
    for kind, b in BUCKET.items():
        bucket = F.when(F.col("combo_type") == kind, b).otherwise(bucket)
    out = k.select(*key, "combo_type", reject.alias("reject_reason"), "out", bucket.alias("bucket"))
    return out.select(
        *key, "combo_type", "reject_reason", "out", F.when(F.col("reject_reason").isNull(), F.col("bucket")).alias("bucket"),
        F.when(F.col("combo_type") == "average", F.nullif(F.regexp_extract(raw, AVERAGE, 1), F.lit("")).cast("int")).alias("avg_years"),
        F.when(F.col("combo_type") == "pack", F.regexp_extract(raw, PACK, 1)).alias("pack_type"))


def resolve_rows(rows: DataFrame, roots: DataFrame, excluded: Column | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Every combo row with its key's outcome: resolve once per distinct key, join back by equality.

    keys: rows that hold every key, such as the definitions; it spares a second pass over the rows. A row of an excluded venue gets the
    reason `venue_unsupported`, a row whose key is incomplete `incomplete_key`; neither is resolved. The distinct keys' outcomes are written
    once, so that a filter on them is not evaluated inside the leg expressions.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in KEYS])
    own = rows if keys is None else keys
    table = materialize(resolve_keys(own.where(whole).select(*KEYS), roots), "combo-keys")
    j = rows.join(table.withColumn("__hit", F.lit(True)), list(KEYS), "left")
    out = F.when(F.col("__hit").isNull(), F.lit("incomplete_key")).otherwise(F.col("reject_reason"))
    no = F.lit(False) if excluded is None else F.coalesce(excluded, F.lit(False))
    drop = {c: F.when(~no, F.col(c)) for c in ("out", "bucket", "avg_years", "pack_type")}
    return j.withColumns({"reject_reason": F.when(no, F.lit("venue_unsupported")).otherwise(out), **drop}).drop("__hit")


def bucket_table(resolved: DataFrame, bucket: str) -> DataFrame:
    """Flat leg columns of one combo table."""
    names = LEG_NAMES[bucket]
    x = resolved.where(F.col("bucket") == bucket)
    legs = [F.get("out", F.lit(i))[f].alias(f"{n}_{f}") for i, n in enumerate(names)
            for f in (("root", "contract_symbol", "expiry_year", "expiry_code") if bucket != "average" else ("contract_symbol", "expiry_year", "expiry_code"))]
    extra = {"average": ["root", "avg_years"], "pack": ["pack_type"]}.get(bucket, [])
    return x.select("date", "open", "high", "low", "close", "volume", "asset", F.col("raw_symbol").alias(f"{bucket}_symbol"), *extra, *legs)


def reject_counts(resolved: DataFrame) -> DataFrame:
    """Row (not key) counts per reject reason."""
    return resolved.where("reject_reason is not null").groupBy("asset", "reject_reason").agg(F.count(F.lit(1)).alias("row_count"))


#: Where a raw row ends: why it is dropped, or the table it is in.
TARGETS = ("unmatched", "sentinel", "other_class", "z_variant", "incomplete_price", "outright", *LEG_NAMES,
           "venue_unsupported", "incomplete_key", "not_2_legs", "leg_parse_fail", "unknown_root", "user_defined")
# The names of a manifest's counters and remarks, in their order.
COUNTERS = {"join_unmatched_rows": "unmatched", "other_instrument_class_rows": "other_class", "outright_rows": "outright", "spread_rows": "spread",
            "butterfly_rows": "butterfly", "condor_rows": "condor", "average_rows": "average", "pack_rows": "pack"}
REMARKS = {"sentinel_price_rows_dropped": "sentinel", "ice_outright_Z_variant_excluded": "z_variant", "outright_incomplete_price_rows_dropped": "incomplete_price",
           "ICE_schema_unsupported_spreads": "venue_unsupported", "spread_unknown_root_exchange": "unknown_root", "spread_not_2_legs": "not_2_legs",
           "spread_leg_parse_fail": "leg_parse_fail", "user_defined_spreads": "user_defined", "spread_incomplete_key": "incomplete_key"}


def routed(bars: DataFrame, defs: DataFrame, roots: DataFrame, excluded: Column, arrival: str = "arrival", one_a_day: bool = False) -> DataFrame:
    """Every raw bar with its definition, prices scaled, and the target it goes to: one plan over the bars.

    bars carry asset and root, so a bar without definition keeps its asset. Combo keys are resolved from the definitions.
    one_a_day: the bars are distinct by (instrument, date).
    """
    own = [c for c in ("asset", "root") if c in defs.columns]
    x = ingest.define_bars(bars, defs.drop(*own), arrival, one_a_day)
    kind, no = ingest.instrument_kind(), F.coalesce(excluded, F.lit(False))
    drop = (F.when(F.col("raw_symbol").isNull(), "unmatched").when(ingest.has_sentinel(), "sentinel").when(kind == "other", "other_class")
            .when(kind == "combo", None).when(no & ingest.z_variant(), "z_variant").when(ingest.exact_zero(), "incomplete_price").otherwise("outright"))
    x = ingest.scale_prices(x.withColumn("__target", drop).withColumn("kind", kind))
    inst = bars.select("instrument_id", "asset", "root").distinct()
    keys = defs.drop(*own).where("instrument_class = 'S'").join(inst, "instrument_id") if not own else defs.where("instrument_class = 'S'")
    r = resolve_rows(x, roots, excluded, keys)
    return r.withColumn("target", F.coalesce("__target", "reject_reason", "bucket")).drop("__target")


def transform(bars: DataFrame, defs: DataFrame, roots: DataFrame, excluded: Column, arrival: str = "arrival", one_a_day: bool = False) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """All output tables, the rejects and the manifest, every asset in one plan; and the counters observed while it was written.

    Raw rows are written once, by target, and each table reads its own partition.
    """
    obs = Observation("transform")
    every = routed(bars, defs, roots, excluded, arrival, one_a_day)
    seen = every.observe(obs, F.count(F.lit(1)).alias("rows_read"), *[ingest.count_if(F.col("target") == t).alias(t) for t in TARGETS])
    rows = materialize(seen, "transform", ("target",))
    out = {"term_structure": ingest.outright_rows(rows.where("target = 'outright'"))}
    out.update({b: bucket_table(rows.where(F.col("target") == b), b) for b in LEG_NAMES})
    out["rejects"] = reject_counts(rows.where("kind = 'combo'"))
    out["manifest"] = manifest(rows, roots)
    return out, obs.get


def manifest(rows: DataFrame, products: DataFrame, by: str = "asset") -> DataFrame:
    """One row per asset: counters, status and remarks; a product without raw rows is NO_RAW_DATA.

    products may have its own column `by`; else its leg_root names the asset.
    """
    out = F.col("target") == "outright"
    bad = out & ((F.col("open") <= 0) | (F.col("high") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0))
    n = {t: ingest.count_if(F.col("target") == t) for t in TARGETS}
    a = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows_read"), *[n[t].alias(c) for c, t in COUNTERS.items()], ingest.count_if(bad).alias("non_positive_price_rows"),
        ingest.count_if(out & (F.col("volume") == 0)).alias("zero_volume_outright_rows"), ingest.count_if(out & ingest.ohlc_violation()).alias("ohlc_violation_rows"),
        *[n[t].alias(f"__{r}") for r, t in REMARKS.items()])
    every = products.select((F.col(by) if by in products.columns else F.col("leg_root")).alias(by)).distinct()
    a = every.join(a, by, "full")
    said = F.concat_ws("; ", *[F.when(F.col(f"__{r}") > 0, F.concat(F.lit(f"{r}="), F.col(f"__{r}").cast("string"))) for r in REMARKS])
    odd = (said != "") | (F.col("join_unmatched_rows") > 0) | (F.col("non_positive_price_rows") > 0) | (F.col("ohlc_violation_rows") > 0)
    status = F.when(F.col("rows_read").isNull(), "NO_RAW_DATA").when(odd, "PARTIAL").otherwise("OK")
    names = ["rows_read", *COUNTERS, "non_positive_price_rows", "zero_volume_outright_rows", "ohlc_violation_rows"]
    return a.select(by, *[F.coalesce(c, F.lit(0)).alias(c) for c in names], status.alias("status"), F.nullif(said, F.lit("")).alias("detail"))
