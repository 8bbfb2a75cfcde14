"""Many specifications on one data set, read once."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame

from ..functions.spec import data_requirements, merge_requirements
from ..sources.data import content_fingerprint, ordered_projection
from ..sources.scratch import written
from .linear import ivhdfe, olshdfe
from .report import TABLE, Result


@dataclass(frozen=True)
class OLSSpec:
    y: str
    x: tuple = ()
    absorb: tuple = ()
    label: str | None = None


@dataclass(frozen=True)
class IVSpec:
    y: str
    exog: tuple = ()
    endog: tuple = ()
    instruments: tuple = ()
    absorb: tuple = ()
    label: str | None = None


class Session:
    """Fits of specifications on the columns that they need, written once; common settings hold for all fits.

    Tables of results can be kept in a folder, named by the data's contents, the specification and the settings.
    """

    def __init__(self, data: DataFrame, specs=(), cache: str | None = None, **common):
        self.common, self.cache, self.data = common, cache, data
        roles = {k: common[k] for k in ("cluster", "weights", "time", "panel") if common.get(k) is not None}
        needs = merge_requirements(*(data_requirements(**{k: v for k, v in asdict(s).items() if k != "label" and v}, **roles) for s in specs))
        self.frame = written(ordered_projection(data, [r.column for r in needs])) if specs else data
        self.fits: dict = {}

    def fit(self, spec: OLSSpec | IVSpec) -> Result:
        if spec not in self.fits:
            args = {k: v for k, v in asdict(spec).items() if k != "label"}
            self.fits[spec] = (olshdfe if isinstance(spec, OLSSpec) else ivhdfe)(self.frame, **args, **self.common)
        return self.fits[spec]

    def fit_many(self, specs) -> list[Result]:
        return [self.fit(s) for s in specs]

    def fit_many_y(self, ys, x=(), absorb=()) -> list[Result]:
        return self.fit_many([OLSSpec(y, tuple(x), tuple(absorb)) for y in ys])

    def table(self, spec: OLSSpec | IVSpec) -> DataFrame:
        """The coefficient table of a specification, from the cache if it is there."""
        spark = self.frame.sparkSession
        if not self.cache:
            return self.fit(spec).table(spark)
        key = hashlib.blake2b(json.dumps([content_fingerprint(self.frame), repr(spec), repr(sorted(self.common.items()))]).encode(), digest_size=16).hexdigest()
        path = str(PurePosixPath(self.cache) / key)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            self.fit(spec).table(spark).write.mode("overwrite").parquet(path)
        return spark.read.schema(TABLE).parquet(path)

    def close(self) -> None:
        for r in self.fits.values():
            r.release()
        self.fits.clear()
