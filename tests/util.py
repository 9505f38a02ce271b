import numpy as np

DATA = "/root/testdata/sf0.001"


def same(got, want) -> None:
    """Two pandas frames hold the same rows, whatever their order; numbers to six places."""
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)

    def plain(df):
        df = df[sorted(df.columns)].copy()
        for c in df.columns:
            if df[c].dtype.kind == "f":
                df[c] = df[c].round(6) + 0.0
            df[c] = df[c].map(lambda x: "null" if x is None or x is np.nan else str(x))
        return sorted(map(tuple, df.to_numpy().tolist()))

    assert plain(got) == plain(want)
