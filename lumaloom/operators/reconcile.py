"""Entity resolution over assets: families of equal content, blocked by opposing decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import pixels as X
from ..functions import times as T
from .scratch import written


def kept(df: DataFrame, name: str) -> DataFrame:
    """:func:`written`, never broadcast: a file of ids takes few bytes a row, so its size does not tell that the rows fill a driver."""
    return written(df, name).hint("merge")


def min_label_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): smallest label around, with hooking of what carries a label and pointer jumping, until nothing changes."""
    both = kept(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node")
    labels, step = kept(labels, "labels"), 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        low = kept(labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("low")), f"low-{step}")
        # a node that is another's label takes the smallest label that one of these meets: chains of small ends do not pass it on step by step
        ends = F.array(F.struct(F.col("node").alias("at"), F.col("old").alias("to")), F.struct(F.col("old").alias("at"), F.col("low").alias("to")))
        jump = low.select(F.inline(ends)).groupBy("at").agg(F.min("to").alias("to"))
        new = kept(low.join(jump, F.col("low") == F.col("at")).select("node", "old", F.least("low", "to").alias("component")), f"step-{step}")
        if new.filter("old <> component").isEmpty():
            return new.select("node", "component")
        labels, step = new.select("node", "component"), step + 1


def reconcile(assets: DataFrame, files: DataFrame) -> DataFrame:
    """asset_id, survivor: assets that share a file's content become one, unless their decisions oppose.

    The survivor of a family is a decided asset if there is one, then the oldest,
    then the smallest id.
    """
    joined = files.select("asset_id", "media_type", "sha256").distinct().join(assets.select("asset_id", "selection_state"), "asset_id")
    state = F.col("selection_state")
    family = joined.groupBy("media_type", "sha256").agg(F.min("asset_id").alias("head"), F.count("*").alias("n"), F.bool_or(state == "selected").alias("yes"), F.bool_or(state == "rejected").alias("no"))
    free = family.filter("n > 1 and not (yes and no)").select("media_type", "sha256", "head")
    edges = joined.join(free, ["media_type", "sha256"]).filter("asset_id <> head").select(F.col("head").alias("a"), F.col("asset_id").alias("b")).distinct()
    found = min_label_components(edges)
    members = found.join(assets, found["node"] == assets["asset_id"]).select("component", "asset_id", "selection_state", "created_day")
    key = F.struct(F.when(F.col("selection_state") == "undecided", 1).otherwise(0), "created_day", "asset_id")
    heads = members.groupBy("component").agg(F.min_by("asset_id", key).alias("survivor"))
    return members.join(heads, "component").select("asset_id", "survivor")


def moments(when: Column) -> dict[str, Column]:
    """Columns of both sides a and b from their capture_time and its kind: seconds ``s``, wall clock ``w`` and what they mean, ``axis``."""
    out = {}
    for n in ("a", "b"):
        time, kind = F.col(f"{n}_capture_time"), F.col(f"{n}_capture_time_kind")
        out |= {f"{n}_s": T.capture_seconds(time, kind), f"{n}_w": T.wall_clock_us(time), f"{n}_axis": T.semantics(kind)}
    return {n: F.when(when, c) for n, c in out.items()}


def stem_pairs(assets: DataFrame, files: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """stem, raw_asset, rendered_asset, outcome, rule: RAW files and rendered ones that one stem names.

    assets(asset_id, selection_state, capture_time, capture_time_kind, camera),
    files(asset_id, filename, extension, media_type, role); managed and derived
    files and JXL do not count.  One asset on each side is a pair unless times or
    cameras speak against it; times of other semantics need the same camera.  More
    assets on a side are ``ambiguous``, opposing decisions a ``decision_conflict``,
    and one asset on both sides is ``already_reconciled``.  A stem keeps two ids a
    side, however often it occurs.
    """
    role = F.lower(F.coalesce("role", F.lit("")))
    own = files.filter((F.col("media_type") == "image") & ~role.startswith("managed") & ~role.startswith("derived") & (F.lower("extension") != ".jxl"))
    raw = M.is_raw(F.col("extension"))
    ends = [f(F.when(c, F.col("asset_id"))).alias(n) for n, f, c in (("r0", F.min, raw), ("r1", F.max, raw), ("j0", F.min, ~raw), ("j1", F.max, ~raw))]
    met = own.groupBy(M.casefold(M.stem(F.col("filename"))).alias("stem")).agg(*ends).filter("r0 is not null and j0 is not null")
    known = assets.select("asset_id", "selection_state", "capture_time", "capture_time_kind", F.lower(F.trim("camera")).alias("camera"))
    side = lambda n, key: known.select(*[F.col(c).alias(f"{n}_{c}" if c != "asset_id" else key) for c in known.columns])
    unique = (F.col("r0") == F.col("r1")) & (F.col("j0") == F.col("j1"))
    # times are read where two assets meet alone, not for every asset on either side
    j = met.join(side("a", "r0"), "r0", "left").join(side("b", "j0"), "j0", "left")
    j = X.held(j, moments(unique & (F.col("r0") != F.col("j0"))))
    timed = F.col("a_s").isNotNull() & F.col("b_s").isNotNull()
    cameras = F.col("a_camera").isNotNull() & F.col("b_camera").isNotNull()
    mixed = timed & (F.col("a_axis") != F.col("b_axis"))
    far = F.when(mixed, F.abs(F.col("a_w") - F.col("b_w")) / 1e6).otherwise(F.abs(F.col("a_s") - F.col("b_s"))) > tolerance
    against = (timed & far) | (mixed & ~cameras) | (cameras & (F.col("a_camera") != F.col("b_camera")))
    rule = (
        F.when(mixed, "same_stem+capture_time_mixed_semantics+camera").when(timed & cameras, "same_stem+capture_time+camera").when(timed, "same_stem+capture_time")
        .when(cameras, "same_stem+camera").otherwise("unique_same_stem_no_conflict")
    )
    opposed = F.array_sort(F.array("a_selection_state", "b_selection_state")) == F.array(F.lit("rejected"), F.lit("selected"))
    outcome = F.when(~unique, "ambiguous").when(F.col("r0") == F.col("j0"), "already_reconciled").when(F.coalesce(against, F.lit(False)), None).when(F.coalesce(opposed, F.lit(False)), "decision_conflict").otherwise("paired")
    one = lambda lo, hi: F.when(F.col(lo) == F.col(hi), F.col(lo))
    out = j.select("stem", one("r0", "r1").alias("raw_asset"), one("j0", "j1").alias("rendered_asset"), outcome.alias("outcome"), rule.alias("rule")).filter("outcome is not null")
    return out.withColumn("rule", F.when(F.col("outcome").isin("paired", "decision_conflict"), F.col("rule")))


#: How far two pictures of one scene may be apart (root mean square and histogram as shares, gradient bits).
RMSE_MOST, BITS_MOST, HISTOGRAM_MOST = 0.08, 10, 0.12


def camera_of(files: DataFrame) -> DataFrame:
    """asset_id, camera: the one maker and model that an asset's files name (trimmed, without case); none if they name several."""
    name = lambda c: M.casefold(F.trim(F.coalesce(c, F.lit(""))))
    named = files.select("asset_id", F.struct(name("make").alias("make"), name("model").alias("model")).alias("camera")).filter("camera.make <> '' or camera.model <> ''")
    return named.groupBy("asset_id").agg(F.min("camera").alias("low"), F.max("camera").alias("high")).filter("low = high").select("asset_id", F.concat_ws("\0", "low.make", "low.model").alias("camera"))


def survivors(assets: DataFrame, edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """asset_id, survivor of every asset that edges(a, b) connect to another and that is not blocked: decided first, then the oldest, then the smallest id."""
    members = min_label_components(edges).join(assets.select("asset_id", "selection_state", "created_at"), F.col("node") == F.col("asset_id")).join(blocked, "asset_id", "left_anti")
    key = F.struct((F.col("selection_state") == "undecided").alias("open"), "created_at", "asset_id")
    heads = members.groupBy("component").agg(F.min_by("asset_id", key).alias("survivor"))
    return kept(members.join(heads, "component").select("asset_id", "survivor"), "survivors")


def renamed_to(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """df with ``column`` replaced by its survivor where it has one."""
    to = names.filter("asset_id <> survivor").select(F.col("asset_id").alias("__from"), F.col("survivor").alias("__to"))
    return df.join(to, F.col(column) == F.col("__from"), "left").withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")


def content_families(assets: DataFrame, files: DataFrame) -> DataFrame:
    """media_type, sha256, head, assets, files, chosen, refused: families of content in several assets, with the smallest asset of either decision."""
    known = files.filter("sha256 <> ''").groupBy("media_type", "sha256", "asset_id").agg(F.count("*").alias("n")).join(assets.select("asset_id", "selection_state"), "asset_id")
    side = lambda v: F.min(F.when(F.col("selection_state") == v, F.col("asset_id")))
    return known.groupBy("media_type", "sha256").agg(F.min("asset_id").alias("head"), F.count("*").alias("assets"), F.sum("n").alias("files"), side("selected").alias("chosen"), side("rejected").alias("refused"))


def similar_pictures(pairs: DataFrame, sides: tuple[DataFrame, DataFrame], pictures: DataFrame, facts: DataFrame) -> DataFrame:
    """p, q, rmse, bits, histogram: pictures within the limits of each other, in both orders, if a pair of assets has one on either side.

    pairs(l, r, left) of assets, left where the right one brings its pictures to the
    left one; a side's files(asset_id, picture), pictures(picture, small_red,
    small_green, small_blue, bits), facts(picture, bits, mean, segments).  A picture
    is brought to an asset once, however many others bring it.  There it meets the
    asset's own in a segment of their bits: of one more segments than bits may
    differ, one is equal.
    """
    shown = [s.select("asset_id", "picture").distinct() for s in sides]
    told = facts.select("picture", "bits", "mean", F.posexplode("segments").alias("i", "segment"))
    side = lambda df, n: df.join(told, "picture").select("asset_id", "i", "segment", *[F.col(c).alias(f"{n}_{c}") for c in ("picture", "bits", "mean")])
    met = []
    for cond, owner, guest, own, other in (("left", "l", "r", *shown), ("not left", "r", "l", *shown[::-1])):
        ends = pairs.filter(cond)
        brought = ends.join(other.withColumnRenamed("asset_id", guest), guest).select(F.col(owner).alias("asset_id"), "picture").distinct()
        met.append(side(own.join(ends.select(F.col(owner).alias("asset_id")).distinct(), "asset_id", "left_semi"), "a").hint("merge").join(side(brought, "b"), ["asset_id", "i", "segment"]))
    bits = F.aggregate(F.zip_with("a_bits", "b_bits", lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x)
    near = met[0].unionByName(met[1]).filter(F.abs(F.col("a_mean") - F.col("b_mean")) <= RMSE_MOST + 1e-9).filter(bits <= BITS_MOST)
    near = kept(near.select(F.least("a_picture", "b_picture").alias("p"), F.greatest("a_picture", "b_picture").alias("q"), bits.alias("bits")).distinct(), "near")
    grids = ["small_red", "small_green", "small_blue"]
    grid = lambda n, key: pictures.select(F.col("picture").alias(key), F.struct(*grids).alias(n))
    both = near.filter("p <> q").join(grid("l", "p"), "p").join(grid("r", "q"), "q")
    both = both.withColumn("rmse", F.sqrt(X.mean_squared_error(*[[F.col(f"{s}.{c}") for c in grids] for s in ("l", "r")]) / 65025)).filter(F.col("rmse") <= RMSE_MOST)
    both = X.held(both, {f"{s}_hist": F.concat(*[F.transform(X.histogram_counts(F.col(f"{s}.{c}"), 16), lambda n: n.cast("double")) for c in grids]) for s in ("l", "r")})
    apart = F.aggregate(F.zip_with("l_hist", "r_hist", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / (F.size("l.small_red") * 6)
    both = kept(both.select("p", "q", "rmse", "bits", apart.alias("histogram")).filter(F.col("histogram") <= HISTOGRAM_MOST), "similar")
    same = near.filter("p = q").select("p", "q", F.lit(0.0).alias("rmse"), "bits", F.lit(0.0).alias("histogram"))
    return same.union(both).union(both.select(F.col("q").alias("p"), F.col("p").alias("q"), "rmse", "bits", "histogram"))


def peer_evidence(files: DataFrame, pictures: DataFrame, assets: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """stem, jxl_asset, rendered_asset, rmse, bits, histogram: JPEG XL and rendered assets of one stem that show the same, each pair by its best files.

    files(file_id, asset_id, stem, extension, width, height, picture), unmanaged
    images; pictures(picture, small_red, small_green, small_blue, bits);
    assets(asset_id, capture_time, capture_time_kind, camera).  Pictures within the
    limit of the root mean square have means within it, so assets of a stem meet in a
    band of the mean brightness.  What they show does not depend on the stem: an asset
    of many stems is held against each other asset once, and two pictures once in all.
    """
    jxl, raw = F.lower("extension") == ".jxl", M.is_raw(F.col("extension"))
    small = F.concat("small_red", "small_green", "small_blue")
    facts = pictures.select("picture", "bits", (F.aggregate(small, F.lit(0).cast("long"), lambda a, x: a + x) / (F.size(small) * 255)).alias("mean"))
    cut = lambda i: F.floor(F.size("bits") * i / (BITS_MOST + 1)).cast("int")
    facts = facts.filter("mean is not null and bits is not null and not exists(bits, x -> x is null)")
    facts = kept(facts.withColumn("band", F.floor(F.col("mean") / RMSE_MOST).cast("int")).withColumn("segments", F.array(*[F.array_join(F.slice("bits", cut(i) + 1, cut(i + 1) - cut(i)), ",") for i in range(BITS_MOST + 1)])), "facts")
    told = files.filter("picture is not null").join(facts.select("picture", "band"), "picture").groupBy("asset_id", (~jxl & ~raw).alias("rendered"), "picture", "band", "width", "height").agg(F.min("file_id").alias("file_id"))
    # any file of an asset with a JPEG XL under the stem may stand for it; of the other side only rendered files
    told = kept(told, "told")
    shown = (told.groupBy("asset_id", "picture", "band", "width", "height").agg(F.min("file_id").alias("file_id")), told.filter("rendered").drop("rendered"))
    stems = lambda cond, key, bands: files.filter(cond).select("asset_id", "stem").distinct().join(bands.distinct(), "asset_id").withColumnRenamed("asset_id", key)
    wide = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    left, right = stems(jxl, "l", shown[0].select("asset_id", wide)), stems(~jxl & ~raw, "r", shown[1].select("asset_id", "band"))
    met = kept(left.join(right, ["stem", "band"]).filter("l <> r").select("stem", "l", "r").distinct(), "met")
    size = lambda i, key: shown[i].groupBy(F.col("asset_id").alias(key)).agg(F.count("*").alias(f"n_{key}"))
    # of a pair, the asset with fewer pictures is spelled out
    pairs = kept(met.select("l", "r").distinct().join(size(0, "l"), "l").join(size(1, "r"), "r").select("l", "r", (F.col("n_l") >= F.col("n_r")).alias("left")), "pairs")
    similar = kept(similar_pictures(pairs, shown, pictures, facts), "alike")
    by = lambda i, key: shown[i].select(F.col("asset_id").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in ("picture", "width", "height", "file_id")])
    found = [
        pairs.filter(cond).join(by(i, few), few).join(similar, F.col(f"{few}_picture") == F.col(p)).join(by(1 - i, many).withColumnRenamed(many, "__many"), (F.col(many) == F.col("__many")) & (F.col(q) == F.col(f"{many}_picture")))
        for cond, i, few, many, p, q in (("left", 1, "r", "l", "q", "p"), ("not left", 0, "l", "r", "p", "q"))
    ]
    known = lambda side: (F.coalesce(F.col(f"{side}_width"), F.lit(0)) > 0) & (F.coalesce(F.col(f"{side}_height"), F.lit(0)) > 0)
    sized = ~(known("l") & known("r")) | ((F.col("l_width") == F.col("r_width")) & (F.col("l_height") == F.col("r_height")))
    best = found[0].unionByName(found[1]).filter(sized).groupBy("l", "r").agg(F.min(F.struct("rmse", "l_file_id", "r_file_id", "bits", "histogram")).alias("best"))
    best = met.join(best, ["l", "r"]).withColumnsRenamed({"l": "jxl_asset", "r": "rendered_asset"})
    facts = assets.select("asset_id", "capture_time", "capture_time_kind", "camera")
    side = lambda n, key: facts.select(*[F.col(c).alias(key if c == "asset_id" else f"{n}_{c}") for c in facts.columns])
    j = X.held(best.join(side("a", "jxl_asset"), "jxl_asset").join(side("b", "rendered_asset"), "rendered_asset"), moments(F.lit(True)))
    apart = F.when(F.col("a_axis") != F.col("b_axis"), F.abs(F.col("a_w") - F.col("b_w")) / 1e6).otherwise(F.abs(F.col("a_s") - F.col("b_s")))
    timed = F.col("a_s").isNotNull() & F.col("b_s").isNotNull()
    against = (timed & F.coalesce(apart > tolerance, F.lit(True))) | F.coalesce(F.col("a_camera") != F.col("b_camera"), F.lit(False))
    return j.filter(~against).select("stem", "jxl_asset", "rendered_asset", "best.rmse", "best.bits", "best.histogram")


def _opposed(pairs: DataFrame, assets: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with ``opposed``: one side is selected, the other rejected."""
    for column, name in ((left, "__l"), (right, "__r")):
        pairs = pairs.join(assets.select(F.col("asset_id").alias(column), F.col("selection_state").alias(name)), column, "left")
    both = F.array_sort(F.array("__l", "__r")) == F.array(F.lit("rejected"), F.lit("selected"))
    return pairs.withColumn("opposed", F.coalesce(both, F.lit(False))).drop("__l", "__r")


def reconcile_stages(assets: DataFrame, files: DataFrame, tolerance: float = 5.0, pictures: DataFrame | None = None) -> dict[str, DataFrame]:
    """Entity resolution in three stages, each on the assets that the one before left.

    assets(asset_id, selection_state, created_at, capture_time, capture_time_kind);
    files(file_id, asset_id, filename, extension, media_type, role, sha256, width,
    height, make, model, small_red, small_green, small_blue, bits), the last four of
    :func:`pixels.identity_features`, null without a picture.  With pictures(picture,
    small_red, small_green, small_blue, bits), files name one in ``picture`` instead.

    1. Content in several assets makes them one, unless their decisions oppose;
       then all of them are blocked.  2. A RAW and a rendered asset, each alone
       under a stem, become one if nothing speaks against it.  3. So do a JPEG XL
       and a rendered asset, the only pair under a stem that shows the same.

    Returned tables: ``assets`` (asset_id, survivor, capture_time,
    capture_time_kind: a survivor without a time takes that of the last of its
    assets that has one), ``files`` (file_id, asset_id, role after it all),
    ``relations`` (kind, left_asset, right_asset, stem, rule) and ``conflicts``
    (kind, left_asset, right_asset, stem).  Relations and conflicts are between
    assets, for content from the smallest one to each other: the pairs of files
    behind them are what :func:`sides` spells out.
    """
    assets, files = assets.hint("merge"), files.hint("merge")
    if pictures is None:
        # equal pictures are one, and no file carries its pixels through the stages
        shown = ["small_red", "small_green", "small_blue", "bits"]
        files = files.withColumn("picture", F.when(F.col("small_red").isNotNull(), F.sha2(F.to_json(F.struct(*shown)), 256)))
        pictures = kept(files.filter("picture is not null").groupBy("picture").agg(*[F.first(c).alias(c) for c in shown]), "pictures")
        files = files.drop(*shown)
    pictures = pictures.hint("merge")
    role = F.lower(F.coalesce("role", F.lit("")))
    own = files.filter((F.col("media_type") == "image") & ~role.startswith("managed") & ~role.startswith("derived")).withColumn("stem", M.casefold(M.stem(F.col("filename"))))
    families = kept(content_families(assets, files).filter("assets > 1"), "families")
    opposed = F.col("chosen").isNotNull() & F.col("refused").isNotNull()
    member = files.select("media_type", "sha256", "asset_id").distinct()
    blocked = kept(member.join(families.filter(opposed), ["media_type", "sha256"]).select("asset_id").distinct(), "blocked")
    first = kept(member.join(families.filter(~opposed).select("media_type", "sha256", "head"), ["media_type", "sha256"]).filter("asset_id <> head").select(F.col("head").alias("a"), F.col("asset_id").alias("b")).distinct(), "exact")
    one = survivors(assets, first, blocked)

    # stage 2: stems with one RAW and one rendered asset
    mine = renamed_to(own, one, "asset_id")
    known = assets.join(camera_of(mine), "asset_id", "left")
    found = kept(stem_pairs(known, mine, tolerance), "stems")
    stopped = lambda df, l, r: df.join(blocked.withColumnRenamed("asset_id", l), l, "left_anti").join(blocked.withColumnRenamed("asset_id", r), r, "left_anti")
    raw_pairs = stopped(found.filter("outcome = 'paired'"), "raw_asset", "rendered_asset")
    raw_against = stopped(found.filter("outcome = 'decision_conflict'"), "raw_asset", "rendered_asset")
    second = kept(first.union(raw_pairs.select("raw_asset", "rendered_asset")), "second")
    two = survivors(assets, second, blocked)

    # stage 3: stems with one JPEG XL and rendered pair that shows the same
    late = renamed_to(own, two, "asset_id")
    peers = kept(peer_evidence(late, pictures, assets.join(camera_of(late), "asset_id", "left"), tolerance), "peers")
    single = peers.groupBy("stem").agg(F.count("*").alias("n"), F.min(F.struct("jxl_asset", "rendered_asset")).alias("p")).select("stem", "n", "p.*")
    judged = kept(_opposed(stopped(single.filter("n = 1"), "jxl_asset", "rendered_asset"), assets, "jxl_asset", "rendered_asset"), "judged")
    third = kept(second.union(judged.filter(~F.col("opposed")).select("jxl_asset", "rendered_asset")), "third")
    last = survivors(assets, third, blocked)

    same = found.filter("outcome = 'already_reconciled'").withColumn("rule", F.lit("already_reconciled"))
    pair = lambda df, kind, left, right, rule: df.select(F.lit(kind).alias("kind"), F.col(left).alias("left_asset"), F.col(right).alias("right_asset"), "stem", rule.alias("rule"))
    nothing = F.lit(None).cast("string")
    content = member.join(families.select("media_type", "sha256", "head"), ["media_type", "sha256"]).filter("asset_id <> head").select("head", "asset_id").distinct().withColumn("stem", nothing)
    relations = (
        pair(content, "exact_duplicate", "head", "asset_id", F.lit("sha256"))
        .unionByName(pair(raw_pairs, "raw_jpeg", "raw_asset", "rendered_asset", F.col("rule"))).unionByName(pair(same, "raw_jpeg", "raw_asset", "rendered_asset", F.col("rule")))
        .unionByName(pair(judged.filter(~F.col("opposed")), "external_rendered_peer", "jxl_asset", "rendered_asset", F.lit("same_stem+dimensions+visual_identity")))
    )
    against = lambda df, kind, left, right: df.select(F.lit(kind).alias("kind"), F.col(left).alias("left_asset"), F.col(right).alias("right_asset"), "stem")
    conflicts = (
        against(families.filter(opposed).withColumn("stem", nothing), "exact_duplicate_decision_conflict", "chosen", "refused").distinct()
        .unionByName(against(raw_against, "manual_decision_conflict", "raw_asset", "rendered_asset")).unionByName(against(found.filter("outcome = 'ambiguous'"), "ambiguous_raw_jpeg", "raw_asset", "rendered_asset"))
        .unionByName(against(judged.filter("opposed"), "manual_decision_conflict", "jxl_asset", "rendered_asset")).unionByName(against(single.filter("n > 1"), "ambiguous_external_rendered_peer", "jxl_asset", "rendered_asset"))
    )

    merged = last.filter("asset_id <> survivor").select("asset_id", "survivor")
    times = merged.join(assets.select("asset_id", "capture_time", "capture_time_kind"), "asset_id").filter("capture_time <> ''").groupBy("survivor").agg(F.max_by(F.struct("capture_time", "capture_time_kind"), "asset_id").alias("t"))
    out = assets.join(merged, "asset_id", "left").withColumn("survivor", F.coalesce("survivor", "asset_id")).join(times.withColumnRenamed("survivor", "__s"), F.col("asset_id") == F.col("__s"), "left")
    empty = F.coalesce(F.col("capture_time"), F.lit("")) == ""
    taken = lambda c: F.when(empty & F.col("t").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(c)).alias(c)
    out = out.select("asset_id", "survivor", taken("capture_time"), taken("capture_time_kind"))

    paired = sides(relations.filter("kind = 'raw_jpeg'"), mine).filter("side = 'right'").select("file_id").distinct().withColumn("rendered", F.lit(True))
    moved = renamed_to(files.select("file_id", "asset_id", F.col("asset_id").alias("__was"), "extension", "role"), merged, "asset_id").join(paired, "file_id", "left")
    part = F.when(M.is_raw(F.col("extension")), "camera_raw").when(F.col("rendered"), "camera_jpeg").when(F.col("asset_id") != F.col("__was"), "source_original").otherwise(F.col("role"))
    return {"assets": out, "files": moved.select("file_id", "asset_id", part.alias("role")), "relations": relations, "conflicts": conflicts}


def sides(relations: DataFrame, files: DataFrame) -> DataFrame:
    """left_asset, right_asset, side, file_id: the RAW files of the left and the rendered files of the right asset of RAW and rendered relations."""
    jxl, raw = F.lower("extension") == ".jxl", M.is_raw(F.col("extension"))
    ends = relations.select("left_asset", "right_asset").distinct()
    of = lambda side, cond: ends.join(files.filter(cond).select(F.col("asset_id").alias(f"{side}_asset"), "file_id"), f"{side}_asset").select("left_asset", "right_asset", F.lit(side).alias("side"), "file_id")
    return of("left", raw).union(of("right", ~raw & ~jxl))
