"""Parameters of the analysis, all of them arguments with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    bins: int = 6
    w_sigma: int = 20
    w_liq: int = 20
    w_z: int = 252
    min_visits: int = 100
    t_least: float = 2.0
    regimes: tuple[str, ...] = ("TREND", "RANGE")
    horizon: int = 20
    cost: float = 0.003
    ann: int = 252
    train_end: str = "2022-12-31"
    test_start: str = "2023-01-01"
    horizons: tuple[int, ...] = (1, 3, 5, 10, 20, 60)
    folds: tuple[int, ...] = (2021, 2022, 2023, 2024, 2025, 2026)
    pass_sharpe: float = 1.0
    pass_mdd: float = -0.30
    sys_min_pass: int = 5
    sys_min_mean: float = 1.0
    sys_max_cv: float = 0.5
    sma: int = 120
    dd_bear: float = -0.10
    dd_recover: float = -0.05
    dd_bull: float = 0.0
    cell_visits: int = 30
    eps: float = 1e-12
    live_window: int = 252
    std_floor: float = 1e-6
    z_clip: float = 5.0
    live_eps: float = 1e-8
    top_assets: int = 20
    top_states: int = 50
    latent: int = 8

    @property
    def states(self) -> int:
        return self.bins**4


DEFAULT = Params()
#: For the driver's tables: their years, and fewer visits per state.
TABLES = Params(min_visits=10, train_end="1999-12-31", test_start="2000-01-01", folds=(1998, 1999, 2000, 2001), live_window=60)
#: For the classes of states on the driver's tables, whose greedy trades are too few: all one-day holdings count as trades, states are
#: told apart by three of the four bins, and the regimes' drawdowns are those of a market made of noise.
CLASSES, CLASS_STATES = replace(TABLES, cell_visits=5, t_least=1.0, dd_bear=-0.99, dd_recover=-0.98, dd_bull=-0.97), TABLES.bins**3
