"""Cropped or edited copies of images by local descriptors.

Grey images are rows (id, width, height, pixels), one byte a pixel.  On each level of a pyramid (each ``STEP``
times smaller) all corners (Harris measure over ``QUALITY``, local maxima) become points, so a larger image has more;
each has an orientation (direction of its patch's centroid) and ``BITS`` binary tests of smoothed pixel pairs, whose
places are turned by that orientation.  Brightness and contrast changes keep the tests' signs; crops keep the points.

Images with equal pixels form a class with the smallest id as representative, so copies are searched
once.  Blocks of queries meet blocks of images, of about ``QUERY_POINTS`` and ``IMAGE_POINTS`` points each.  In each, the
images' points lie in ``TABLES`` Hamming tables, each keyed by a part of the tests, and are probed with
the query's part and all keys a bit or more away from it, so that every pair of points at a distance of
at most ``RADIUS`` over all tests is found.  Geometric consensus follows: a pair of images whose close points agree
roughly in turn and scale is fitted.  Each of its candidates proposes its own turn and scale; those that agree with it
give a similarity transform by least squares, which is fitted once more to the candidates near it.  The pair is linked if
``INLIERS`` different places agree with one transform.

Result: (query_id, match_id, match_copies, n_points, n_inliers), for each query and matched class.  ``matches``
gives one row a query instead, with its matches in lists of bounded length.

Defined cases: null, empty or wrongly sized pixels have no points and match nothing; images under 24
pixels wide or high likewise; flat images have no corners; repeated rows and equal images are one
class; an id may repeat; a null id is not searched, and such images match nothing; an empty table gives an empty
result; extra columns are ignored.  Embeddings with nulls, NaN or infinite numbers have no image.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._arrow import kept, ragged, released, shared_folder

BITS = 128
TABLES = 7
RADIUS = 12
QUERY_POINTS = 1 << 18
IMAGE_POINTS = 1 << 18
CANDIDATES = 1 << 18
HEAVY = 1 << 10  # pairs of points of one key that are compared as a block
LIST_IMAGES = 100_000  # images that a list of matches is drawn from
QUALITY = 1.0  # Harris measure of the weakest corner
APART = 4  # pixels in which a corner is the strongest
STEP = math.sqrt(2)
STACK_PIXELS = 1 << 19  # pixels described at once
BORDER = 6  # pixels from the edge that a corner must lie, and pixels repeated around an image for its tests
INLIERS = 6
PLACE = 4  # pixels in which points are one place
NEAR = 2.0  # pixels of its level that a point may lie off the transform
ANGLES = 72
SECTORS = 24  # of turns, in twos

def _chosen_tests(tries: int = 1500, reach: int = 10, blur: float = 2.5) -> np.ndarray:
    """(y, x) of both pixels of ``BITS`` tests that tell as much as can be in a smooth image, table by table.

    How alike two tests are follows from their places, for pixels whose correlation falls with distance like a bell curve of
    width ``blur``.  The test least like those chosen comes next; each goes to the table whose tests are least like it.
    """
    random = np.random.default_rng(99)
    tests = random.integers(-reach, reach + 1, (2 * tries, 2, 2)).astype(np.float64)
    tests = tests[(np.hypot(tests[..., 0], tests[..., 1]) <= reach).all(1) & (np.abs(tests[:, 0] - tests[:, 1]).sum(1) >= 2)][:tries]
    p, q = tests[:, 0], tests[:, 1]
    near = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * blur**2))
    alike = near(p, p) - near(p, q) - near(q, p) + near(q, q)
    alike = np.abs(alike) / np.sqrt(np.outer(np.diag(alike), np.diag(alike)))
    most, taken = np.zeros(len(tests)), [0]
    while len(taken) < BITS:
        most = np.maximum(most, alike[taken[-1]])
        most[taken] = np.inf
        taken.append(int(np.argmin(most)))
    tables: list[list[int]] = [[] for _ in range(TABLES)]
    for k in taken:
        room = [t for t in range(TABLES) if len(tables[t]) < BITS * (t + 1) // TABLES - BITS * t // TABLES]
        tables[min(room, key=lambda t: ((alike[k, tables[t]] ** 2).sum(), len(tables[t])))].append(k)
    return tests[[k for t in tables for k in t]]


_TESTS = _chosen_tests()
_TURNED = np.stack([np.round(_TESTS @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])).astype(np.int32) for t in np.arange(ANGLES) * 2 * np.pi / ANGLES])
_DISC = np.array([(y, x) for y in range(-6, 7) for x in range(-6, 7) if x * x + y * y <= 36], np.int32)


def _sums(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2 r + 1 pixels of each image of a stack, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        p, n = np.pad(a, pad, mode="edge"), a.shape[axis]
        at = lambda k: p[:, k : k + n] if axis == 1 else p[:, :, k : k + n]  # noqa: B023, E731
        a = at(0).copy()
        for k in range(1, 2 * r + 1):
            a += at(k)
    return a


def _most_near(a: np.ndarray, r: int) -> np.ndarray:
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        p, n = np.pad(a, pad, mode="edge"), a.shape[axis]
        a = p[:, :n].copy() if axis == 1 else p[:, :, :n].copy()
        for k in range(1, 2 * r + 1):
            np.maximum(a, p[:, k : k + n] if axis == 1 else p[:, :, k : k + n], out=a)
    return a


def _shrunk(a: np.ndarray) -> np.ndarray:
    """Each image ``STEP`` times smaller, by linear interpolation."""
    for axis in (1, 2):
        n = int(a.shape[axis] / STEP)
        at = (np.arange(n) + 0.5) * STEP - 0.5
        low = np.minimum(np.floor(at).astype(np.int64), a.shape[axis] - 2)
        part = (at - low).astype(np.float32)
        part = part[:, None] if axis == 1 else part
        a = np.take(a, low, axis) * (1 - part) + np.take(a, low + 1, axis) * part
    return a


def describe(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of images of one size: each point's image, place (y, x in the full image), level, turn (radians) and tests (bits as bytes)."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros((0, 2), np.float32)], [np.zeros(0, np.uint8)], [np.zeros(0, np.float32)], [np.zeros((0, BITS // 8), np.uint8)]]
    image = stack.astype(np.float32)
    for level in itertools.count():
        n, h, w = image.shape
        if min(h, w) < 2 * BORDER + 12:
            break
        smooth = _sums(image, 1) / np.float32(9)
        gy, gx = np.zeros_like(smooth), np.zeros_like(smooth)
        gy[:, 1:-1] = (smooth[:, 2:] - smooth[:, :-2]) / 2
        gx[:, :, 1:-1] = (smooth[:, :, 2:] - smooth[:, :, :-2]) / 2
        xx, yy, xy = (_sums(g, 2) / np.float32(25) for g in (gx * gx, gy * gy, gx * gy))
        corner = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
        peak = (corner >= _most_near(corner, APART)) & (corner > QUALITY)
        peak[:, :BORDER], peak[:, -BORDER:], peak[:, :, :BORDER], peak[:, :, -BORDER:] = False, False, False, False
        padded = np.pad(smooth, ((0, 0), (BORDER, BORDER), (BORDER, BORDER)), mode="edge")
        flat, scale = padded.ravel(), STEP**level
        h, w = padded.shape[1:]
        own, y, x = np.nonzero(peak)
        for start in range(0, len(own), 8192):
            o, b, a = (c[start : start + 8192] for c in (own, y, x))
            base = ((o * h + b + BORDER) * w + a + BORDER).astype(np.int64)
            patch = flat[base[:, None] + (_DISC[:, 0] * w + _DISC[:, 1])]
            patch = patch - patch.mean(1, keepdims=True)
            angle = np.arctan2(patch @ _DISC[:, 0].astype(np.float32), patch @ _DISC[:, 1].astype(np.float32))
            turn = np.round(angle * ANGLES / (2 * np.pi)).astype(np.int64) % ANGLES
            at = (_TURNED[..., 0] * w + _TURNED[..., 1])[turn]
            less = flat[base[:, None] + at[:, :, 0]] < flat[base[:, None] + at[:, :, 1]]
            places = (np.stack([b, a], 1).astype(np.float32) + np.float32(0.5)) * np.float32(scale) - np.float32(0.5)
            for column, values in zip(found, (o, places, np.full(len(o), level, np.uint8), angle.astype(np.float32), np.packbits(less, axis=1)), strict=True):
                column.append(values)
        image = _shrunk(smooth)
    out = [np.concatenate(x) for x in found]
    order = np.argsort(out[0], kind="stable")
    return tuple(x[order] for x in out)  # type: ignore[return-value]


POINTS = "n int, places binary, levels binary, turns binary, tests binary"
_POINTS = ("n", "places", "levels", "turns", "tests")
_NONE = (0, b"", b"", b"", b"")


def _described(shapes: list[tuple[int, int]], pixels: list[bytes | None]) -> list[tuple]:
    """The points of each image, packed; images of one size are described together."""
    out: list[tuple] = [_NONE] * len(pixels)
    by_size: dict[tuple[int, int], list[int]] = {}
    for k, ((w, h), p) in enumerate(zip(shapes, pixels, strict=True)):
        if p and w and h and w > 0 and len(p) == w * h:
            by_size.setdefault((h, w), []).append(k)
    for (h, w), own in by_size.items():
        some = max(1, STACK_PIXELS // (h * w))
        for at in range(0, len(own), some):
            part = own[at : at + some]
            image, places, levels, turns, tests = describe(np.frombuffer(b"".join(pixels[k] for k in part), np.uint8).reshape(-1, h, w))
            ends = np.searchsorted(image, np.arange(len(part) + 1))
            for i, k in enumerate(part):
                s = slice(ends[i], ends[i + 1])
                out[k] = (int(ends[i + 1] - ends[i]), places[s].tobytes(), levels[s].tobytes(), turns[s].tobytes(), tests[s].tobytes())
    return out


def described(images: DataFrame) -> DataFrame:
    """One row an image: id, a digest of its pixels and size, and its points."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = list(zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True))
            pixels = batch.column("pixels").to_pylist()
            digests = [hashlib.sha256(f"{w}x{h}:".encode() + (p or b"")).digest() for (w, h), p in zip(shapes, pixels, strict=True)]
            points = _described(shapes, pixels)
            kinds = (pa.int32(), *[pa.binary()] * 4)
            columns = [pa.array([p[c] for p in points], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.binary()), *columns], names=["id", "digest", *_POINTS])

    return images.select(F.col("id").cast("long").alias("id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("pixels").cast("binary").alias("pixels")).mapInArrow(find, f"id long, digest binary, {POINTS}")


def _parts() -> list[tuple[int, int, np.ndarray]]:
    """For each table: its bits (from, to), and the masks that a key is probed with.

    The tables' radii and one each add up to more than ``RADIUS``, so a pair within ``RADIUS`` is within one table's radius in that table.
    """
    extra = RADIUS + 1 - TABLES
    out = []
    for k in range(TABLES):
        low, high = BITS * k // TABLES, BITS * (k + 1) // TABLES
        radius = extra // TABLES + (k < extra % TABLES)
        masks = [sum(1 << b for b in some) for n in range(radius + 1) for some in itertools.combinations(range(high - low), n)]
        out.append((low, high, np.array(masks, np.int64)))
    return out


class Tables:
    """The tests of a block of points, by the parts of them that are keys; each table has them in order of its keys."""

    def __init__(self, tests: np.ndarray):
        self.size, self.parts, self.tables = len(tests), _parts(), []
        words = _words(tests)
        for (low, high, _), keys in zip(self.parts, self._keys(tests), strict=True):
            starts = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << (high - low)))])
            order = np.argsort(keys, kind="stable")
            self.tables.append((starts, order, [w[order] for w in words]))

    def _keys(self, tests: np.ndarray) -> list[np.ndarray]:
        bits = np.unpackbits(tests, axis=1)
        return [bits[:, low:high] @ (1 << np.arange(high - low, dtype=np.int64)) for low, high, _ in self.parts]

    def close(self, tests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (row of ``tests``, row of the block) at a distance of at most ``RADIUS``, once each."""
        words, found, total = _words(tests), [np.zeros(0, np.int64)], max(1, self.size)
        for (_, _, masks), keys, (starts, order, own_words) in zip(self.parts, self._keys(tests), self.tables, strict=True):
            probes = (keys[:, None] ^ masks).ravel()
            some = np.flatnonzero(starts[probes + 1] > starts[probes])
            some = some[np.argsort(probes[some], kind="stable")]
            probes, mine = probes[some], some // len(masks)
            first, many = starts[probes], starts[probes + 1] - starts[probes]
            at = np.flatnonzero(_changes(probes))
            asking = np.diff(np.append(at, len(probes)))
            heavy = asking * many[at] >= HEAVY
            for a, n in zip(at[heavy].tolist(), asking[heavy].tolist(), strict=True):  # a key of many points on both sides: all against all, in blocks
                low, high = int(first[a]), int(first[a] + many[a])
                rows = max(1, CANDIDATES // (high - low))
                for b in range(a, a + n, rows):
                    own = mine[b : min(b + rows, a + n)]
                    off = np.bitwise_count(words[0][own][:, None] ^ own_words[0][low:high])
                    i, j = np.nonzero(off <= RADIUS)
                    near = off[i, j] + np.bitwise_count(words[1][own[i]] ^ own_words[1][low + j]) <= RADIUS
                    found.append(own[i[near]] * total + order[low + j[near]])
            light = np.repeat(~heavy, asking)
            mine, first, many = mine[light], first[light], many[light]
            ends, at = np.cumsum(many), 0
            while at < len(mine):  # a bounded number of candidates at once
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, side="right")))
                asked, own = np.repeat(mine[at:stop], many[at:stop]), ragged(first[at:stop], many[at:stop])
                off = np.bitwise_count(words[0][asked] ^ own_words[0][own])
                near = off <= RADIUS  # most are too far off by the first half already
                asked, own, off = asked[near], own[near], off[near]
                near = off + np.bitwise_count(words[1][asked] ^ own_words[1][own]) <= RADIUS
                found.append(asked[near] * total + order[own[near]])
                at = stop
        pairs = np.unique(np.concatenate(found))
        return pairs // total, pairs % total


def _words(tests: np.ndarray) -> list[np.ndarray]:
    """Tests as 64-bit numbers, a column each."""
    wide = np.ascontiguousarray(tests).view(np.uint64).reshape(-1, BITS // 64)
    return [wide[:, k].copy() for k in range(BITS // 64)]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _flat(table: pa.Table) -> dict[str, np.ndarray]:
    """Points of all images of a block: place (x + i y), scale, turn, tests, and the place of the image in the block."""
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    places = join("places", np.float32).reshape(-1, 2).astype(np.float64)
    return {
        "z": places[:, 1] + 1j * places[:, 0], "level": join("levels", np.uint8).astype(np.int64), "turn": join("turns", np.float32).astype(np.float64),
        "tests": join("tests", np.uint8).reshape(-1, BITS // 8), "image": np.repeat(np.arange(table.num_rows), table.column("n").to_numpy()),
    }


def _places(z: np.ndarray) -> int:
    """Different places among points."""
    return len(np.unique(np.floor(z.real / PLACE) + 1j * np.floor(z.imag / PLACE)))


def consensus(zq: np.ndarray, zm: np.ndarray, turn: np.ndarray, scale: np.ndarray, off: np.ndarray, least: int) -> int:
    """The most places of both images that agree with one similarity transform.

    Candidates are pairs of places; each proposes a turn and a scale, and ``off`` is how far it may lie from the transform, in the match.
    """
    best, n = 0, len(zq)
    for start in range(0, n, max(1, (1 << 20) // n)):
        seeds = slice(start, start + max(1, (1 << 20) // n))
        from_q, from_m = zq[None] - zq[seeds, None], zm[None] - zm[seeds, None]
        guess = (scale[seeds] * np.exp(1j * turn[seeds]))[:, None] * from_q
        rough = np.abs(from_m - guess) <= 0.35 * np.abs(guess) + 2 * off[None]
        rough = rough[rough.sum(1) >= least]
        if len(rough):
            rough = np.unique(rough, axis=0)
        for some in rough:  # different groups of candidates only
            if some.sum() <= best:
                continue
            for _ in range(2):
                a, b = zq[some], zm[some]
                mean_a, mean_b = a.mean(), b.mean()
                spread = (np.abs(a - mean_a) ** 2).sum()
                if not spread:
                    break
                rate = (np.conj(a - mean_a) * (b - mean_b)).sum() / spread
                some = np.abs(zm - mean_b - rate * (zq - mean_a)) <= off
                if some.sum() < least:
                    break
            else:
                if 0.2 <= abs(rate) <= 5:
                    best = max(best, min(_places(zq[some]), _places(zm[some] / max(1.0, abs(rate)))))
    return best


def _agreeing(q: dict[str, np.ndarray], m: dict[str, np.ndarray], qi: np.ndarray, mi: np.ndarray, inliers: int) -> tuple[np.ndarray, ...]:
    """Geometric consensus of close points: query image, image, query points with a close one, and places that agree."""
    images = int(m["image"][-1]) + 1
    pair = q["image"][qi] * images + m["image"][mi]
    order = np.lexsort((qi, pair))
    pair, qi, mi = pair[order], qi[order], mi[order]
    starts = np.flatnonzero(_changes(pair))
    n_points = np.add.reduceat(_changes(pair, qi).astype(np.int64), starts)
    enough = n_points >= inliers  # most pairs of images have too few and need no fit
    kept_rows = np.repeat(enough, np.diff(starts, append=len(pair)))
    nth = np.repeat(np.arange(enough.sum()), np.diff(starts, append=len(pair))[enough])
    named, n_points = pair[starts][enough], n_points[enough]
    qi, mi = qi[kept_rows], mi[kept_rows]
    nothing = (np.zeros(0, np.int64),) * 4
    if not len(qi):
        return nothing
    turn, levels = m["turn"][mi] - q["turn"][qi], m["level"][mi] - q["level"][qi]
    # rough agreement: points by sector of turns and step of scale, each twice as wide as its step
    sector = np.floor(turn % (2 * np.pi) * SECTORS / (2 * np.pi)).astype(np.int64)
    kind = np.concatenate([(nth * 128 + levels + 32 + s) * SECTORS + (sector + t) % SECTORS for t in (0, 1) for s in (0, 1)])
    point = np.tile(qi, 4)
    order = np.lexsort((point, kind))
    kind, point = kind[order], point[order]
    first = np.flatnonzero(_changes(kind))
    most = np.zeros(len(named), np.int64)
    np.maximum.at(most, kind[first] // (128 * SECTORS), np.add.reduceat(_changes(kind, point).astype(np.int64), first))
    at, agreed = np.searchsorted(nth, np.arange(len(named) + 1)), np.zeros(len(named), np.int64)
    scale = STEP ** levels.astype(np.float64)
    off = NEAR * STEP ** np.maximum(m["level"][mi], 0) * np.maximum(1.0, scale * STEP ** (q["level"][qi] - m["level"][mi]))
    for k in np.flatnonzero(most >= inliers):
        s = slice(at[k], at[k + 1])
        agreed[k] = consensus(q["z"][qi[s]], m["z"][mi[s]], turn[s], scale[s], off[s], inliers)
    linked = agreed >= inliers
    return named[linked] // images, named[linked] % images, n_points[linked], agreed[linked]


def _match(asked: pa.Table, block: pa.Table, inliers: int) -> pa.Table:
    """Linked images of a block of queries and a block of images."""
    out = [np.zeros((4, 0), np.int64)]
    if asked.num_rows and block.num_rows:
        q, m = _flat(asked), _flat(block)
        tables = Tables(m["tests"])
        ends, at = np.cumsum(np.bincount(q["image"], minlength=asked.num_rows)), 0
        while at < len(q["image"]):  # whole queries, some ten thousand points of them at once
            stop = int(ends[max(q["image"][at], np.searchsorted(ends, at + 32768, side="right") - 1)])
            qi, mi = tables.close(q["tests"][at:stop])
            if len(qi):
                out.append(np.stack(_agreeing(q, m, qi + at, mi, inliers)))
            at = stop
    qs, ms, n_points, n_inliers = np.concatenate(out, axis=1)
    columns = [asked.column("id").take(pa.array(qs)), block.column("id").take(pa.array(ms)), block.column("copies").take(pa.array(ms)), pa.array(n_points), pa.array(n_inliers)]
    return pa.Table.from_arrays(columns, names=["q_id", "m_id", "match_copies", "n_points", "n_inliers"])


def search(images: DataFrame, queries: DataFrame, inliers: int = INLIERS) -> DataFrame:
    """Matches of ``queries`` among ``images``."""
    folder = shared_folder(images.sparkSession)
    classes = lambda table: table.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first(F.struct(*_POINTS)).alias("p")).select("digest", "id", "copies", "p.*")
    asked = kept(described(queries), folder, "queries")
    base, query = kept(classes(described(images)), folder, "images"), kept(classes(asked), folder, "query-classes")
    released(images.sparkSession)
    blocks = lambda table, points: max(1, -(-(table.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0) // points))
    across, down = blocks(query, QUERY_POINTS), blocks(base, IMAGE_POINTS)
    dealt = lambda n: F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = lambda table: table.where((F.col("n") >= inliers) & F.col("id").isNotNull())
    left = some(query).withColumn("across", dealt(across)).withColumn("down", each(down)).drop("digest")
    right = some(base).withColumn("down", dealt(down)).withColumn("across", each(across)).drop("digest")

    def match(asked: pa.Table, block: pa.Table) -> pa.Table:
        return _match(asked, block, inliers)

    found = left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInArrow(match, "q_id long, m_id long, match_copies long, n_points long, n_inliers long")
    members = asked.where("id is not null").select(F.col("id").alias("query_id"), "digest").join(query.select("digest", F.col("id").alias("q_id")), "digest")
    return members.join(found, "q_id").select("query_id", F.col("m_id").alias("match_id"), "match_copies", "n_points", "n_inliers").distinct()


def matches(images: DataFrame, queries: DataFrame, inliers: int = INLIERS) -> DataFrame:
    """(query_id, list, n_matches, match_ids, copies, n_inliers) of ``search``: all matches of a query, by falling inliers.

    Matches of one query grow with its group of near copies, so they are lists: one row a query and list, where a list holds
    matches among about ``LIST_IMAGES`` images; a query without matches has one row with empty lists.
    """
    found = kept(search(images, queries, inliers), shared_folder(images.sparkSession), "found")
    lists = max(1, -(-images.count() // LIST_IMAGES))
    one = F.struct((-F.col("n_inliers")).alias("less"), F.col("match_id").alias("id"), F.col("match_copies").alias("copies"))
    dealt = found.withColumn("list", F.pmod(F.xxhash64("match_id"), F.lit(lists)).cast("int")).groupBy("query_id", "list").agg(F.array_sort(F.collect_list(one)).alias("m"))
    none = queries.select(F.col("id").cast("long").alias("query_id")).where("query_id is not null").distinct()
    out = none.join(dealt, "query_id", "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<less: long, id: long, copies: long>>")))
    return out.select(
        "query_id", F.coalesce("list", F.lit(0)).alias("list"), F.size("m").cast("long").alias("n_matches"), F.col("m.id").alias("match_ids"), F.col("m.copies").alias("copies"),
        F.transform("m", lambda x: -x["less"]).alias("n_inliers"),
    )


SIDE = 116
_waves = np.random.default_rng(7)
_CYCLES = np.exp(_waves.uniform(np.log(4.0), np.log(14.0), 64))
_TURNS, _PHASES = _waves.uniform(0, 2 * np.pi, 64), _waves.uniform(0, 2 * np.pi, 64)


def _wave_images() -> np.ndarray:
    """64 plane waves of 4 to 14 cycles an image, of any direction; longer waves are stronger."""
    y, x = np.mgrid[0:SIDE, 0:SIDE] / SIDE
    waves = np.cos(2 * np.pi * _CYCLES[:, None, None] * (np.cos(_TURNS)[:, None, None] * x + np.sin(_TURNS)[:, None, None] * y) + _PHASES[:, None, None])
    return (waves / np.sqrt(_CYCLES)[:, None, None]).reshape(64, -1).astype(np.float32)


def rasters(embeddings: DataFrame) -> DataFrame:
    """Embeddings of 64 numbers as grey images of SIDE x SIDE: each number is the strength of a plane wave, so near vectors are near images."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waves = _wave_images()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vectors = part.column("embedding").to_pylist()
                good = [k for k, v in enumerate(vectors) if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
                pixels: list[bytes | None] = [None] * len(vectors)
                if good:
                    grids = np.array([vectors[k] for k in good], np.float64)
                    grids /= np.maximum(np.sqrt((grids**2 / _CYCLES).sum(1, keepdims=True)), 1e-300)
                    drawn = np.clip(np.round(128 + 60 * (grids.astype(np.float32) @ waves)), 0, 255).astype(np.uint8)
                    for k, row in zip(good, drawn, strict=True):
                        pixels[k] = row.tobytes()
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([SIDE] * n, pa.int32()), pa.array([SIDE] * n, pa.int32()), pa.array(pixels, pa.binary())], names=["id", "width", "height", "pixels"])

    return embeddings.select(F.col("vec_id").cast("long").alias("id"), "embedding").mapInArrow(draw, "id long, width int, height int, pixels binary")


EDITS = ("crop", "quarter turn", "turn", "half", "larger", "double", "noise", "blur")


def _sampled(image: np.ndarray, height: int, width: int, rate: float, radians: float = 0.0) -> np.ndarray:
    """An image of the given size about the centre of ``image``: 1 / rate of its pixels a pixel, turned; edges repeat."""
    y, x = np.mgrid[0:height, 0:width]
    y, x = (y - (height - 1) / 2) / rate, (x - (width - 1) / 2) / rate
    h, w = image.shape
    at_y = np.clip((h - 1) / 2 + np.cos(radians) * y - np.sin(radians) * x, 0, h - 1)
    at_x = np.clip((w - 1) / 2 + np.sin(radians) * y + np.cos(radians) * x, 0, w - 1)
    b, a = np.minimum(at_y.astype(int), h - 2), np.minimum(at_x.astype(int), w - 2)
    fy, fx = at_y - b, at_x - a
    return (image[b, a] * (1 - fx) + image[b, a + 1] * fx) * (1 - fy) + (image[b + 1, a] * (1 - fx) + image[b + 1, a + 1] * fx) * fy


def edit(image: np.ndarray, kind: str, seed: int) -> np.ndarray:
    """An edited copy: a crop of three quarters of each side with less contrast; turns by 90 and 37 degrees; scales; noise; blur."""
    h, w = image.shape
    f = image.astype(np.float64)
    if kind == "crop":
        ch, cw = 3 * h // 4, 3 * w // 4
        y, x = seed % (h - ch + 1), (seed >> 8) % (w - cw + 1)
        f = f[y : y + ch, x : x + cw] * 0.9 + 12
    elif kind == "quarter turn":
        f = np.rot90(f)
    elif kind == "turn":
        f = _sampled(f, int(h * 0.7), int(w * 0.7), 1.0, math.radians(37))
    elif kind == "half":
        f = f[: h // 2 * 2, : w // 2 * 2]
        f = (f[::2, ::2] + f[1::2, ::2] + f[::2, 1::2] + f[1::2, 1::2]) / 4
    elif kind in ("larger", "double"):
        rate = 1.5 if kind == "larger" else 2.0
        f = _sampled(f, int(h * rate), int(w * rate), rate)
    elif kind == "noise":
        f = f + np.random.default_rng(seed).normal(0, 4.0, f.shape)
    elif kind == "blur":
        f = _sums(f[None], 1)[0] / 9
    return np.ascontiguousarray(np.clip(np.round(f), 0, 255).astype(np.uint8))


def edited(images: DataFrame, kinds: tuple[str, ...] = EDITS) -> DataFrame:
    """An edited copy of each image; its kind depends on the pixels alone."""

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for w, h, p in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "pixels")), strict=True):
                if p:
                    seed = zlib.crc32(p)
                    image = edit(np.frombuffer(p, np.uint8).reshape(h, w), kinds[seed // 65536 % len(kinds)], seed)
                    h, w, p = *image.shape, image.tobytes()
                for column, x in zip(out, (w, h, p), strict=True):
                    column.append(x)
            kinds_ = (pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, t) for x, t in zip(out, kinds_, strict=True))], names=["id", "width", "height", "pixels"])

    return images.mapInArrow(change, "id long, width int, height int, pixels binary")
