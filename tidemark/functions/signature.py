"""Lines of training samples: csv, libsvm and gcformat."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.fingerprint import fingerprint, hash64, signed


@dataclass(frozen=True)
class Feature:
    kind: str  # continuous, discrete, label or index
    value: Column
    bucket: int | None = None  # discrete only; 0 for a size that isn't valid


def _text(x: Column) -> Column:
    """A number as text: floating numbers with six decimals, booleans as 0 and 1."""
    kind = F.typeof(x)
    floating = F.when(F.isnan(x.cast("double")), "nan").when(x.cast("double") == float("inf"), "inf").when(x.cast("double") == float("-inf"), "-inf").otherwise(F.format_string("%f", x.cast("double")))
    return F.when(x.isNull(), None).when(kind.isin("float", "double"), floating).when(kind == "boolean", x.cast("int").cast("string")).otherwise(x.cast("string"))


def continuous(x: Column) -> Feature:
    return Feature("continuous", x)


def discrete(x: Column, bucket: int | None = None, kind: str = "int") -> Feature:
    """The fingerprint of a value of type ``kind``, as an unsigned number within ``bucket`` if one is given; a bucket that isn't positive gives an empty feature."""
    hashed = hash64(x, kind)
    if bucket is None:
        return Feature("discrete", hashed)
    if bucket <= 0:
        return Feature("discrete", F.lit(None).cast("bigint"), 0)
    low = F.shiftrightunsigned(hashed, 1) % bucket * 2 + hashed.bitwiseAND(F.lit(1))
    return Feature("discrete", low % bucket, bucket)


def label(x: Column) -> Feature:
    """Binary, multiclass or regression label."""
    return Feature("label", x)


binary_label = multiclass_label = regression_label = label


def gcformat_index(x: Column) -> Feature:
    return Feature("index", x)


def csv(*features: Feature) -> Column:
    """All values in order; a NULL is empty."""
    parts = [F.lit("") if f.kind == "index" else F.coalesce(_text(f.value), F.lit("")) for f in features]
    return F.concat_ws(",", *parts) if parts else F.lit("")


def _label(features: tuple[Feature, ...]) -> Column:
    """Of several labels the last; "" if that is NULL."""
    labels = [f.value for f in features if f.kind == "label"]
    return F.coalesce(_text(labels[-1]), F.lit("")) if labels else F.lit("")


def libsvm(*features: Feature) -> Column:
    """``label slot:value hash:1 ...``. A dense feature takes one slot, a discrete one as many as its bucket, one without bucket none."""
    slot, parts = 1, []
    for f in features:
        if f.kind == "continuous":
            parts.append(F.concat(F.lit(f"{slot}:"), _text(f.value)))
            slot += 1
        elif f.kind == "discrete":
            parts.append(F.concat((f.value + slot if f.bucket else f.value).cast("string"), F.lit(":1")))
            slot += f.bucket or 0
    body = F.concat_ws(" ", *parts) if parts else F.lit("")
    head = _label(features)
    return F.when(head == "", body).when(body == "", head).otherwise(F.concat_ws(" ", head, body))


def gcformat(*features: Feature) -> Column:
    """``label index| slot:hash(slot):value slot:hash ...``; every feature takes one slot."""
    slot, parts = 1, []
    index: Column = F.lit(" ")
    for f in features:
        if f.kind == "continuous":
            own = signed(fingerprint(slot.to_bytes(8, "little")))
            parts.append(F.concat(F.lit(f"{slot}:{own}:"), _text(f.value)))
            slot += 1
        elif f.kind == "discrete":
            parts.append(F.concat(F.lit(f"{slot}:"), f.value.cast("string")))
            slot += 1
        elif f.kind == "index":
            index = F.when(f.value >= 0, F.concat(F.lit(" "), f.value.cast("string"))).otherwise(index)
    return F.concat(_label(features), index, F.lit("| "), F.concat_ws(" ", *parts) if parts else F.lit(""))
