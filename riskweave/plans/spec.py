"""Stage specifications (JSON) and the registry of what they may name."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..operators import binning, encoders, select

#: Encoders and filters that a specification may name; users add their own with `register`.
REGISTRY: dict[str, type] = {
    "BaseEncoder": select.QualityFilter, "CountEncoder": encoders.CountEncoder, "WOEEncoder": encoders.WOEEncoder, "CateLabelEncoder": encoders.LabelEncoder,
    "CateOneHotEncoder": encoders.OneHotEncoder, "TargetEncoder": encoders.TargetEncoder, "ImputeEncoder": encoders.ImputeEncoder, "ContImputerEncoder": encoders.ContImputerEncoder,
    "ContBinningEncoder": binning.ContBinningEncoder, "CateBinningEncoder": binning.CateBinningEncoder, "BinningEncoder": binning.BinningEncoder, "BinningWOEEncoder": binning.BinningWOEEncoder,
    "ReduceGen": encoders.ReduceGen, "AppCateEncoder": encoders.AppCateEncoder, "FriedScale": encoders.FriedScale, "StableFilter": select.StableFilter,
    "SelectKBestFilter": select.SelectKBest, "SelectFromModelFilter": select.SelectFromModel, "RFEFilter": select.RFE, "LRFilter": select.LRFilter,
    "IndexValueEncoder": encoders.IndexValueEncoder, "ClusterBinEncoder": binning.ClusterBinEncoder,
}
#: Parameter names of specifications, as those of the classes here.
RENAMED = {"specified_features": "columns", "binning_method": "method", "indice_thr": "limit", "n_features_to_select": "n", "woe_min": "woe_min", "woe_max": "woe_max"}
#: Parameters that mean nothing here.
IGNORED = {"inplace", "indice_name", "score_func", "verbose", "sparse_output"}


class NothingEncoder:
    """Leaves rows as they are."""

    def fit(self, df, label=None):
        return self

    def transform(self, df):
        return df


class DropEncoder:
    """Drops its columns."""

    def __init__(self, columns=()):
        self.columns = list(columns)

    def fit(self, df, label=None):
        return self

    def transform(self, df):
        return df.drop(*self.columns)


REGISTRY |= {"NothingEncoder": NothingEncoder, "DropEncoder": DropEncoder, "StableEncoder": NothingEncoder}


def register(cls: type) -> type:
    """Decorator: let specifications name a class with ``fit(df, label)`` and ``transform(df)``."""
    REGISTRY[cls.__name__] = cls
    return cls


def instantiate(method: str, params: dict | None = None):
    """A registered class by name. Nothing is evaluated or imported by name."""
    if method not in REGISTRY:
        raise ValueError(f"unknown method {method!r}")
    kept = {RENAMED.get(k, k): v for k, v in (params or {}).items() if k not in IGNORED and not (k == "specified_features" and v == "infer")}
    return REGISTRY[method](**kept)


@dataclass
class StageSpec:
    """``ds``: data (label, train, test, table), ``out``: destination, ``st``: the stage's settings."""

    ds: dict
    out: dict = field(default_factory=dict)
    st: dict | list = field(default_factory=dict)

    @staticmethod
    def parse(text: str | dict) -> StageSpec:
        raw = json.loads(text) if isinstance(text, str) else dict(text)
        if unknown := set(raw) - {"ds", "out", "st"}:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        if "ds" not in raw:
            raise ValueError("a specification needs ds")
        return StageSpec(raw["ds"], raw.get("out", {}), raw.get("st", {}))

    @property
    def label(self) -> str:
        return self.ds["label"]["name"] if isinstance(self.ds.get("label"), dict) else self.ds.get("label")
