"""Detection on movies kept as one array of pixels per frame
(``recording_id, frame, h, w, px``) or as pixel rows (``…, y, x, v``).

Filters of a frame are narrow maps over the arrays: no pixel crosses the network.
Everything that relates pixels to each other afterwards is a join or an aggregate.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lociflow.session import cut_lineage

FRAME = ["recording_id", "frame"]
# Fixed value: the B3 spline.
B3 = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)
NOISE_FACTOR = 4.4


def pixel_rows(frames: DataFrame) -> DataFrame:
    return (frames.select(*FRAME, "w", F.posexplode("px").alias("_p", "v"))
            .select(*FRAME, F.floor(F.col("_p") / F.col("w")).cast("int").alias("y"),
                    (F.col("_p") % F.col("w")).cast("int").alias("x"), F.col("v").cast("double").alias("v")))


def _shifted_sum(a: np.ndarray, offsets, weights, axis: int, edge: str) -> np.ndarray:
    """Σ weight·(array moved by offset) along an axis; ``edge`` repeats the border
    pixel or mirrors the image."""
    n = a.shape[axis]
    out = np.zeros_like(a, dtype=float)
    for o, w in zip(offsets, weights):
        at = np.arange(n) + o
        if edge == "nearest":
            at = np.clip(at, 0, n - 1)
        else:
            at %= 2 * n
            at = np.where(at >= n, 2 * n - 1 - at, at)
        out += w * np.take(a, at, axis=axis)
    return out


def _both(a, offsets, weights, edge):
    return _shifted_sum(_shifted_sum(a, offsets, weights, 0, edge), offsets, weights, 1, edge)


def map_frames(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a function of one image to every frame."""
    types = {f.name: f.dataType.simpleString() for f in frames.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pdf["px"] = [fn(np.asarray(p, dtype=float).reshape(h, w)).ravel()
                         for p, h, w in zip(pdf["px"], pdf["h"], pdf["w"])]
            yield pdf
    head = ", ".join(f"{c} {types[c]}" for c in (*FRAME, "h", "w"))
    return frames.select(*FRAME, "h", "w", "px").mapInPandas(run, f"{head}, px array<double>")


def project_stack(pixels: DataFrame, k: float = 3.0) -> DataFrame:
    """Mean, maximum and number of blinks (above mean + k·sd) of every pixel."""
    s = pixels.groupBy("recording_id", "y", "x").agg(
        F.avg("v").alias("mean"), F.max("v").alias("max"), F.stddev_pop("v").alias("_sd"))
    hit = pixels.join(s, ["recording_id", "y", "x"]).groupBy("recording_id", "y", "x").agg(
        F.count_if(F.col("v") > F.col("mean") + k * F.col("_sd")).alias("blinks"))
    return s.drop("_sd").join(hit, ["recording_id", "y", "x"])


def subtract_background(frames: DataFrame, radius: int = 50, sigma: float = 1.0) -> DataFrame:
    """Minus the box mean, clipped at zero, smoothed, and scaled to 0…1 per frame;
    a flat frame becomes zero."""
    box = range(-radius, radius + 1)
    reach = int(4 * sigma + 0.5)
    soft = range(-reach, reach + 1)
    g = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    g = (g / g.sum()).tolist()

    def one(a: np.ndarray) -> np.ndarray:
        flat = np.clip(a - _both(a, box, [1 / len(box)] * len(box), "mirror"), 0, None)
        s = _both(flat, soft, g, "nearest")
        lo, hi = s.min(), s.max()
        return (s - lo) / (hi - lo) if hi > lo else np.zeros_like(s)
    return map_frames(frames, one)


def wavelet_w2(frames: DataFrame) -> DataFrame:
    """Second à-trous plane with the B3 spline, border pixels repeated."""
    def one(a: np.ndarray) -> np.ndarray:
        a1 = _both(a, (-2, -1, 0, 1, 2), B3, "nearest")
        return a1 - _both(a1, (-4, -2, 0, 2, 4), B3, "nearest")
    return map_frames(frames, one)


def wavelet_noise(w2: DataFrame) -> DataFrame:
    """Median over all frames of 1.4826·MAD of the detection image."""
    rows = pixel_rows(w2)
    # a frame's pixels are bounded by the camera
    med = rows.groupBy(*FRAME).agg(F.percentile("v", F.lit(0.5)).alias("_m"))
    mad = rows.join(med, FRAME).groupBy(*FRAME).agg(
        (1.4826 * F.percentile(F.abs(F.col("v") - F.col("_m")), F.lit(0.5))).alias("sigma"))
    return mad.groupBy("recording_id").agg(F.percentile("sigma", F.lit(0.5)).alias("sigma"),
                                           F.count(F.lit(1)).alias("n_frames"))


def recommend_threshold(noise: DataFrame, factor: float = NOISE_FACTOR) -> DataFrame:
    """Factor times the noise, to the nearest five counts."""
    return noise.withColumn("threshold", F.greatest(F.lit(5.0), 5.0 * F.bround(factor * F.col("sigma") / 5.0)))


def detect_basins(w2_rows: DataFrame, threshold: float, min_pixels: int = 5) -> DataFrame:
    """Spots as the basins of the maxima of the pixels above a threshold.

    Every pixel points at its highest neighbour (itself for a maximum); pointers
    double until they rest on a maximum, and a basin is summed by the maximum it
    ends on.
    """
    on = w2_rows.where(F.col("v") > threshold)
    shifts = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    rank = lambda a: F.struct(F.col(f"{a}v").alias("v"), (-F.col(f"{a}y")).alias("ny"), (-F.col(f"{a}x")).alias("nx"))
    offers = on.select(*FRAME, F.col("v").alias("ov"), F.col("y").alias("oy"), F.col("x").alias("ox"), F.explode(shifts).alias("s"))
    offers = offers.select(*FRAME, (F.col("oy") + F.col("s.dy")).alias("y"), (F.col("ox") + F.col("s.dx")).alias("x"), rank("o").alias("to"))
    best = offers.groupBy(*FRAME, "y", "x").agg(F.max("to").alias("to"))
    at = cut_lineage(on.join(best, [*FRAME, "y", "x"]).select(
        *FRAME, "y", "x", "v", (-F.col("to.ny")).alias("ty"), (-F.col("to.nx")).alias("tx")))
    while True:
        ahead = at.select(*FRAME, F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("ty").alias("ny"), F.col("tx").alias("nx"))
        moved = cut_lineage(at.join(ahead, [*FRAME, "ty", "tx"]).select(
            *FRAME, "y", "x", "v", F.col("ny").alias("ty"), F.col("nx").alias("tx"),
            ((F.col("ny") != F.col("ty")) | (F.col("nx") != F.col("tx"))).alias("_moved")))
        more = not moved.where("_moved").isEmpty()
        at = moved.drop("_moved")
        if not more:
            break
    spot = at.groupBy(*FRAME, "ty", "tx").agg(
        F.count(F.lit(1)).alias("size"), F.sum("v").alias("mass"),
        (F.sum(F.col("v") * F.col("x")) / F.sum("v")).alias("x"), (F.sum(F.col("v") * F.col("y")) / F.sum("v")).alias("y"))
    return spot.where((F.col("size") >= min_pixels) & (F.col("mass") > 0)).drop("ty", "tx")


def _disk(radius: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx"))
                     for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius])


def local_maxima(rows: DataFrame, diameter: int = 7, percentile: float = 64.0, min_mass: float = 0.0, moves: int = 10) -> DataFrame:
    """Bright maxima refined to the centroid of a disc: candidates equal the
    maximum of their window and exceed a percentile of their frame; the disc moves
    by a pixel while the centroid lies more than 0.6 px off."""
    r = diameter // 2
    cut = rows.groupBy(*FRAME).agg(F.percentile("v", F.lit(percentile / 100)).alias("_cut"),
                                   F.max("y").alias("_h"), F.max("x").alias("_w"))
    across = W.partitionBy(*FRAME, "y").orderBy("x").rangeBetween(-r, r)
    down = W.partitionBy(*FRAME, "x").orderBy("y").rangeBetween(-r, r)
    top = rows.withColumn("_mx", F.max("v").over(across)).withColumn("_mx", F.max("_mx").over(down))
    seeds = (top.where(F.col("v") == F.col("_mx")).join(cut, FRAME).where(F.col("v") > F.col("_cut"))
             .where(F.col("y").between(r, F.col("_h") - r) & F.col("x").between(r, F.col("_w") - r)))
    at = cut_lineage(seeds.select(*FRAME, F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("y").alias("cy"),
                                  F.col("x").alias("cx"), "_h", "_w"))
    pix = rows.select(*FRAME, "y", "x", "v")

    def moments(centres: DataFrame) -> DataFrame:
        spread = centres.withColumn("_o", F.explode(_disk(r))).withColumns(
            {"y": F.col("cy") + F.col("_o.dy"), "x": F.col("cx") + F.col("_o.dx")})
        j = spread.join(pix, [*FRAME, "y", "x"])
        v, dx, dy = F.col("v"), F.col("_o.dx"), F.col("_o.dy")
        return j.groupBy(*FRAME, "sy", "sx", "cy", "cx", "_h", "_w").agg(
            F.sum(v).alias("mass"), F.sum(v * dx).alias("mx"), F.sum(v * dy).alias("my"),
            F.sum(v * (dx * dx + dy * dy)).alias("m2"), F.sum(v * (dx * dx - dy * dy)).alias("mc"), F.sum(2 * v * dx * dy).alias("ms"))
    step = lambda off: F.when(off > 0.6, 1).when(off < -0.6, -1).otherwise(0)      # noqa: E731
    for _ in range(moves):
        m = moments(at).where("mass > 0")
        new = m.select(*FRAME, "sy", "sx", "_h", "_w", "cy", "cx",
                       F.least(F.greatest(F.col("cy") + step(F.col("my") / F.col("mass")), F.lit(r)), F.col("_h") - r).alias("ny"),
                       F.least(F.greatest(F.col("cx") + step(F.col("mx") / F.col("mass")), F.lit(r)), F.col("_w") - r).alias("nx"))
        new = cut_lineage(new)
        settled = new.where("ny = cy AND nx = cx").isEmpty() is False and new.where("ny <> cy OR nx <> cx").isEmpty()
        at = new.select(*FRAME, "sy", "sx", F.col("ny").alias("cy"), F.col("nx").alias("cx"), "_h", "_w")
        if settled:
            break
    m = moments(at).where((F.col("mass") > 0) & (F.col("mass") >= min_mass))
    out = m.select(*FRAME, (F.col("cy") + F.col("my") / F.col("mass")).alias("y"), (F.col("cx") + F.col("mx") / F.col("mass")).alias("x"),
                   "mass", F.sqrt(F.col("m2") / F.col("mass")).alias("size"), (F.hypot("mc", "ms") / F.col("mass")).alias("ecc"), "cy", "cx")
    return out.groupBy(*FRAME, "cy", "cx").agg(*[F.max(c).alias(c) for c in ("y", "x", "mass", "size", "ecc")]).drop("cy", "cx")


def raw_contrast(locs: DataFrame, rows: DataFrame, height: int, width: int, diameter: int = 7) -> DataFrame:
    """``raw_cnr``: centre brightness over the median of a ring, in units of the
    ring's noise; NULL when the patch leaves the frame or the ring has no spread."""
    r = diameter
    ring = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if (diameter / 2) ** 2 <= i * i + j * j <= r * r]
    core = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    offs = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx"), F.lit(k).alias("k"))
                     for k, pts in ((0, core), (1, ring)) for i, j in pts])
    at = locs.withColumns({"_px": F.bround("x").cast("int"), "_py": F.bround("y").cast("int")})
    inside = at.where(F.col("_px").between(r, width - r - 1) & F.col("_py").between(r, height - r - 1))
    spread = inside.select("loc_id", *FRAME, "_py", "_px", F.explode(offs).alias("_o")).select(
        "loc_id", *FRAME, (F.col("_py") + F.col("_o.dy")).alias("y"), (F.col("_px") + F.col("_o.dx")).alias("x"), F.col("_o.k").alias("k"))
    patch = spread.join(rows, [*FRAME, "y", "x"])
    # a ring holds a fixed number of pixels
    med = patch.groupBy("loc_id").agg(F.percentile(F.when(F.col("k") == 1, F.col("v")), F.lit(0.5)).alias("_m"),
                                      F.avg(F.when(F.col("k") == 0, F.col("v"))).alias("_c"))
    noise = patch.where("k = 1").join(med, "loc_id").groupBy("loc_id", "_m", "_c").agg(
        (1.4826 * F.percentile(F.abs(F.col("v") - F.col("_m")), F.lit(0.5))).alias("_s"))
    cnr = noise.select("loc_id", F.when(F.col("_s") > 0, (F.col("_c") - F.col("_m")) / F.col("_s")).alias("raw_cnr"))
    return locs.join(cnr, "loc_id", "left")


# ---- masks from an image (recording_id, y, x, v) -----------------------------------

BINS = 256


def image_histogram(image: DataFrame, bins: int = BINS) -> DataFrame:
    """``(recording_id, bin, center, n)`` over each image's own range."""
    ends = image.groupBy("recording_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / bins
    counts = (image.join(ends, "recording_id")
              .groupBy("recording_id", "lo", "hi", F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    filled = counts.groupBy("recording_id", "lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m")) \
        .select("recording_id", "lo", "hi", "_m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return filled.select("recording_id", "bin", (F.col("lo") + (F.col("bin") + 0.5) * width).alias("center"),
                         F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).alias("n"))


def otsu(hist: DataFrame) -> DataFrame:
    """Threshold of largest variance between the two sides of a 256-bin histogram."""
    up = W.partitionBy("recording_id").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    dn = W.partitionBy("recording_id").orderBy("bin").rowsBetween(1, W.unboundedFollowing)
    h = hist.withColumns({"w1": F.sum("n").over(up), "w2": F.sum("n").over(dn),
                          "s1": F.sum(F.col("n") * F.col("center")).over(up), "s2": F.sum(F.col("n") * F.col("center")).over(dn)})
    gap = F.try_divide("s1", "w1") - F.try_divide("s2", "w2")
    h = h.where(F.col("w2").isNotNull()).withColumn("var", F.col("w1") * F.col("w2") * gap * gap)
    return h.groupBy("recording_id").agg(F.max_by("center", F.struct(F.round("var", 9), -F.col("bin"))).alias("threshold"))


def triangle(hist: DataFrame) -> DataFrame:
    """Threshold furthest from the line between a histogram's peak and the end of
    its longer tail."""
    p = hist.groupBy("recording_id").agg(
        F.max_by("bin", F.struct("n", -F.col("bin"))).alias("peak"), F.max("n").alias("top"),
        F.min(F.when(F.col("n") > 0, F.col("bin"))).alias("lo"), F.max(F.when(F.col("n") > 0, F.col("bin"))).alias("hi"),
        F.max("bin").alias("last"))
    flip = (F.col("peak") - F.col("lo")) < (F.col("hi") - F.col("peak"))
    # work on the side of the longer tail, seen from its far end
    j = hist.join(p.withColumn("flip", flip), "recording_id")
    pos = F.when(F.col("flip"), F.col("last") - F.col("bin")).otherwise(F.col("bin"))
    start = F.when(F.col("flip"), F.col("last") - F.col("hi")).otherwise(F.col("lo"))
    peak = F.when(F.col("flip"), F.col("last") - F.col("peak")).otherwise(F.col("peak"))
    j = j.withColumns({"d": pos - start, "width": peak - start}).where((F.col("d") >= 0) & (F.col("d") < F.col("width")))
    norm = F.sqrt(F.col("top") * F.col("top") + F.col("width") * F.col("width"))
    length = F.col("top") / norm * F.col("d") - F.col("width") / norm * F.col("n")
    j = j.withColumn("len", F.round(length, 9))
    return j.groupBy("recording_id").agg(F.max_by("center", F.struct("len", -F.col("d"))).alias("threshold"))


def li(image: DataFrame, rounds: int = 100) -> DataFrame:
    """Minimum cross-entropy threshold by its fixed point, over merged equal values."""
    d = image.groupBy("recording_id", "v").agg(F.count(F.lit(1)).alias("n"))
    low = d.groupBy("recording_id").agg(F.min("v").alias("_lo"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("t"))
    d = cut_lineage(d.join(low.select("recording_id", "_lo"), "recording_id").withColumn("v", F.col("v") - F.col("_lo")))
    at = cut_lineage(low.select("recording_id", "_lo", (F.col("t") - F.col("_lo")).alias("t")))
    for _ in range(rounds):
        s = d.drop("_lo").join(at, "recording_id").groupBy("recording_id", "_lo", "t").agg(
            F.try_divide(F.sum(F.when(F.col("v") > F.col("t"), F.col("v") * F.col("n"))), F.sum(F.when(F.col("v") > F.col("t"), F.col("n")))).alias("f"),
            F.try_divide(F.sum(F.when(F.col("v") <= F.col("t"), F.col("v") * F.col("n"))), F.sum(F.when(F.col("v") <= F.col("t"), F.col("n")))).alias("b"))
        new = F.when((F.col("b") > 0) & (F.col("f") > F.col("b")), (F.col("b") - F.col("f")) / (F.log("b") - F.log("f"))).otherwise(F.col("t"))
        nxt = cut_lineage(s.select("recording_id", "_lo", new.alias("t"), (F.abs(new - F.col("t")) > 1e-9).alias("_more")))
        more = not nxt.where("_more").isEmpty()
        at = nxt.drop("_more")
        if not more:
            break
    return at.select("recording_id", (F.col("t") + F.col("_lo")).alias("threshold"))


def threshold_mask(image: DataFrame, thresholds: DataFrame, closing: int = 0) -> DataFrame:
    """Pixels above the threshold of their image, optionally closed with a disc."""
    on = image.join(thresholds, "recording_id").where(F.col("v") > F.col("threshold")).select("recording_id", "y", "x")
    if not closing:
        return on
    grow = on.withColumn("_o", F.explode(_disk(closing))).select(
        "recording_id", (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x")).distinct()
    size = sum(1 for i in range(-closing, closing + 1) for j in range(-closing, closing + 1) if i * i + j * j <= closing * closing)
    # a pixel stays when the whole disc around it was reached
    back = grow.withColumn("_o", F.explode(_disk(closing))).groupBy(
        "recording_id", (F.col("y") - F.col("_o.dy")).alias("y"), (F.col("x") - F.col("_o.dx")).alias("x")).agg(F.count(F.lit(1)).alias("_n"))
    return back.where(F.col("_n") == size).select("recording_id", "y", "x").join(
        image.select("recording_id", "y", "x"), ["recording_id", "y", "x"], "left_semi")


def mask_components(mask: DataFrame, min_pixels: int = 1) -> DataFrame:
    """4-connected parts of a mask with at least ``min_pixels``: adds ``component``."""
    from lociflow.operators.graph import connected_components
    node = F.struct("recording_id", "y", "x")
    right = mask.select("recording_id", "y", F.col("x").alias("x0")).select(
        F.struct("recording_id", "y", F.col("x0").alias("x")).alias("a"), F.struct("recording_id", "y", (F.col("x0") + 1).alias("x")).alias("b"))
    below = mask.select("recording_id", F.col("y").alias("y0"), "x").select(
        F.struct("recording_id", F.col("y0").alias("y"), "x").alias("a"), F.struct("recording_id", (F.col("y0") + 1).alias("y"), "x").alias("b"))
    pixels = mask.select(node.alias("b"))
    edges = right.unionByName(below).join(pixels, "b", "left_semi").unionByName(mask.select(node.alias("a"), node.alias("b")))
    comp = connected_components(edges)
    big = comp.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pixels)
    return comp.join(big, "component", "left_semi").select("node.recording_id", "node.y", "node.x", "component")
