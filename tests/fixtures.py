"""Generated fixtures shaped like the reference's three sample files, with planted outliers."""

from __future__ import annotations

import numpy as np
import pandas as pd


def planted_finance(n: int = 100, seed: int = 7) -> tuple[pd.DataFrame, list[int]]:
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({
        "row_id": np.arange(n),
        "islem_id": [f"TXN-{i:03d}" for i in range(n)],
        "islem_tutari": np.round(rng.lognormal(7.6, 0.5, n), 2),
        "islem_adedi": rng.integers(1, 4, n).astype(float),
        "komisyon_orani": rng.choice([0.01, 0.02, 0.025, 0.03], n),
        "kategori": rng.choice(["eft", "havale", "kredi_karti"], n),
        "kanal": rng.choice(["internet", "mobil", "pos", "şube"], n),
    })
    planted = [11, 19, 41, 74]
    df.loc[planted, "islem_tutari"] = [175000.0, 160000.0, 150000.0, 140000.0]
    df.loc[planted, "islem_adedi"] = [52.0, 48.0, 45.0, 40.0]
    df.loc[planted, "komisyon_orani"] = [0.18, 0.15, 0.16, 0.17]
    return df, planted


def planted_calls(n: int = 80, seed: int = 11) -> tuple[pd.DataFrame, list[int]]:
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({
        "row_id": np.arange(n),
        "cagri_suresi_dk": np.round(rng.normal(5, 1, n), 1),
        "bekleme_suresi_sn": rng.integers(20, 60, n).astype(float),
        "memnuniyet_puani": rng.integers(6, 10, n).astype(float),
    })
    planted = [13, 29, 53]
    df.loc[planted, "cagri_suresi_dk"] = [45.0, 40.0, 42.0]
    df.loc[planted, "bekleme_suresi_sn"] = [420.0, 390.0, 400.0]
    df.loc[planted, "memnuniyet_puani"] = 1.0
    return df, planted
