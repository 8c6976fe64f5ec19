"""Scalar functions: Column in, Column out; no Python UDF among them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054
# Directory names that stand for a label.
NEGATIVE_NAMES = ("real", "nature", "0", "human", "photo")
POSITIVE_NAMES = ("fake", "ai", "1", "generated", "synthetic")


def sigmoid(x: Column) -> Column:
    """Without overflow at either end."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def calibrate(x: Column, slope: Column | float, intercept: Column | float) -> Column:
    return sigmoid(x * F.lit(slope) + F.lit(intercept))


def logit(t: Column | float) -> Column:
    t = F.lit(t)
    return F.log(t / (1 - t))


def correct(label: Column, p: Column, threshold: float) -> Column:
    return F.when(label == 1, p >= threshold).otherwise(p < threshold)


def log_loss_row(label: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -F.when(label == 1, F.log(q)).otherwise(F.log(1 - q))


def resolution_bucket(width: Column, height: Column) -> Column:
    w, h = width.try_cast("double"), height.try_cast("double")
    # least() skips nulls, a missing side must not.
    short = F.when(w.isNotNull() & h.isNotNull(), F.least(w, h))
    return (
        F.when(short.isNull(), "unknown").when(short < 128, "<128").when(short < 256, "128-255").when(short < 512, "256-511").when(short < 1024, "512-1023").otherwise(">=1024")
    )


VIEW_LIMITS = {"web": 768, "hard": 512}


def effective_short(width: Column, height: Column, view: Column) -> Column:
    """Short edge after the view's limit on the long edge; half-even rounding, 1 at least."""
    short, long = F.least(width, height), F.greatest(width, height)
    limit = F.when(view == "web", VIEW_LIMITS["web"]).when(view == "hard", VIEW_LIMITS["hard"])
    return F.when(limit.isNotNull() & (long > limit), F.greatest(F.lit(1), F.bround(short * limit / long).cast("long"))).otherwise(short.cast("long"))


def scale_bucket(target: Column, short: Column) -> Column:
    s = F.coalesce(target, F.lit(440)) / short
    return F.when(s < 0.5, "down>2x").when(s <= 1, "down<2x").when(s <= 2, "up<=2x").otherwise("up>2x")


FEATURES = ("log_width", "log_height", "log_aspect", "log_pixels", "log_bytes", "bytes_per_pixel", "is_square", "is_jpeg", "is_png", "is_webp", "has_license")


def metadata_features(width: Column, height: Column, n_bytes: Column, mime: Column, license_: Column) -> list[Column]:
    """The columns FEATURES."""
    w, h, n = F.greatest(width.cast("double"), F.lit(1.0)), F.greatest(height.cast("double"), F.lit(1.0)), n_bytes.cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    m = F.lower(mime)
    cols = [F.log(w), F.log(h), F.log(w / h), F.log(w * h), F.log1p(n), n / (w * h), flag(w == h), flag(m.contains("jpeg")), flag(m.contains("png")), flag(m.contains("webp")), flag(F.length(license_) > 0)]
    return [c.alias(n) for c, n in zip(cols, FEATURES)]


def joined(*parts: Column | str) -> Column:
    return F.concat_ws("\x00", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def content_id(*parts: Column | str) -> Column:
    return F.substring(F.sha2(joined(*parts), 256), 1, 24)


def priority(*parts: Column | str) -> Column:
    """16 hex digits, to be compared as text: a stable order for sampling."""
    return F.substring(F.sha2(joined(*parts), 256), 1, 16)


def hash_number(*parts: Column | str) -> Column:
    """Unsigned 64-bit number of priority(), as a decimal."""
    return F.conv(priority(*parts), 16, 10).cast("decimal(20,0)")


def hash_fold(k: int, *parts: Column | str) -> Column:
    return (hash_number(*parts) % k).cast("int")


def hash_holdout(identity: Column, m: int) -> Column:
    return F.conv(F.substring(identity, 1, 8), 16, 10).cast("bigint") % m == 0


def draw_seed(seed: int, sample: Column, case: Column) -> Column:
    return hash_number(str(seed), sample, case)


def uniform(*parts: Column | str) -> Column:
    """In [0, 1), from the first 32 bits of the hash."""
    return F.conv(F.substring(F.sha2(joined(*parts), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def bits_of(h: Column) -> Column:
    """64 bits of 16 hex digits, as a signed bigint."""
    return F.conv(h, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(bits_of(a).bitwiseXOR(bits_of(b)))


def bands(h: Column, distance: int) -> Column:
    """distance + 1 bands of the 64 bits, the first ones a bit wider: hashes at most `distance` bits apart share one."""
    n, at, out, bits = distance + 1, 64, [], bits_of(h)
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        at -= width
        out.append(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1)).alias("bits")))
    return F.array(*out)


def near_keys(bits: Column, distance: int) -> Column:
    """(band, bits) of which hashes at most `distance` bits apart share one: each choice of `agree` of distance + agree blocks of the 64 bits. bits is named in every key, so it should be a column.

    Up to 4 bits apart 3 of 7 blocks agree: 35 keys of 27 bits or more, so that few rows meet by chance; beyond, blocks would be too narrow and one of distance + 1 does.
    """
    agree = 3 if distance <= 4 else 1
    n = distance + agree
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    keys = []
    for i, choice in enumerate(combinations(range(n), agree)):
        mask = sum(((1 << widths[b]) - 1) << (64 - sum(widths[: b + 1])) for b in choice)
        keys.append(F.struct(F.lit(i).alias("band"), bits.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*keys)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: within a lambda an expression runs again for each element, and where it is named again, again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def median_bits(v: Column) -> Column:
    """16 hex digits: which of 64 coefficients reach the median of the last 63."""
    text = bound(F.element_at(F.array_sort(F.slice(v, 2, 63)), 32), lambda mid: F.array_join(F.transform(v, lambda x: F.when(x >= mid, "1").otherwise("0")), ""))
    half = lambda t, at: F.lpad(F.conv(F.substring(t, at, 32), 2, 16), 8, "0")
    return bound(text, lambda t: F.lower(F.concat(half(t, 1), half(t, 33))))


def is_hex(c: Column, n: int) -> Column:
    return F.coalesce(c.rlike(f"^[0-9a-fA-F]{{{n}}}$"), F.lit(False))


def label_alias(name: Column) -> Column:
    """0, 1 or null."""
    n = F.translate(F.lower(name), "-", "_")
    return F.when(n.isin(*NEGATIVE_NAMES), 0).when(n.isin(*POSITIVE_NAMES), 1)


def group_name(dataset: Column, label: Column, source: Column) -> Column:
    return F.format_string("%s:%s:%s", dataset, F.when(label == 1, "fake").otherwise("real"), source)


def source_name(name: Column, prefix: str = "HuggingFace:") -> Column:
    """The name without the prefix that hosted models carry."""
    return F.when(F.startswith(name, F.lit(prefix)), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name)


def prompt_hash(p: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(p, r"\s+", " ")), 256)


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 120), F.lit("")), F.lit("unknown"))


def extension(path: Column, mime: Column) -> Column:
    e = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    e = F.when(e == "jpeg", "jpg").otherwise(e)
    by_mime = F.when(mime == "image/jpeg", "jpg").when(mime == "image/png", "png").when(mime == "image/webp", "webp").otherwise("bin")
    return F.when(e != "", e).otherwise(by_mime)


def sniff(content: Column, suffix: Column) -> Column:
    """jpg, png or webp by the first bytes, else the suffix."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("52494646") & head.endswith("57454250"), "webp").otherwise(F.lower(suffix))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound, clipped to [0, 1]; null for n = 0."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    d = 1 + F.try_divide(F.lit(z * z), n.cast("double"))
    mid = (p + F.try_divide(F.lit(z * z / 2), n.cast("double"))) / d
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) / d
    some = n > 0  # greatest() and least() skip nulls
    return F.when(some, F.greatest(F.lit(0.0), mid - half)), F.when(some, F.least(F.lit(1.0), mid + half))


def assert_bytes(payload: Column, digest: Column) -> Column:
    """The payload; fails where its SHA-256 isn't the digest."""
    return F.when(F.sha2(payload, 256) == F.lower(digest), payload).otherwise(F.raise_error(F.concat(F.lit("bytes differ from digest "), digest)).cast("binary"))


def l2_normalize(v: Column) -> Column:
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), size))


def linear_score(v: Column, weights: Column, bias: Column | float) -> Column:
    return F.aggregate(F.zip_with(v, weights, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda a, x: a + x) + F.lit(bias)
