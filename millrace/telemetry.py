"""Join telemetry: rows on each side of each join, and estimates of the bytes moved."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

KEY_BYTES, CELL_BYTES, RATES_GB_S = 4, 8, (10.0, 20.0, 40.0)


@dataclass
class Totals:
    """Sums over the joins that had rows to build, to probe and to return."""

    joins: int = 0
    build_rows: int = 0
    probe_rows: int = 0
    out_rows: int = 0
    out_cells: int = 0

    def add(self, build: int, probe: int, out: int, columns: int) -> None:
        if build and out:
            self.joins += 1
            self.build_rows += build
            self.probe_rows += probe
            self.out_rows += out
            self.out_cells += out * columns

    @property
    def bytes_baseline_min(self) -> int:
        return KEY_BYTES * (self.build_rows + self.probe_rows) + CELL_BYTES * self.out_cells

    @property
    def bytes_likely(self) -> int:
        return self.bytes_baseline_min + CELL_BYTES * self.out_cells

    @property
    def selectivity(self) -> float:
        return self.out_rows / self.probe_rows if self.probe_rows else 0.0

    @property
    def columns_per_row(self) -> float:
        return self.out_cells / self.out_rows if self.out_rows else 0.0

    def bounds_ms(self, total: int) -> list[float]:
        """Milliseconds to move ``total`` bytes at each of the rates."""
        return [total / (r * 1e9) * 1000 for r in RATES_GB_S]

    def report(self, seconds: float) -> str:
        rate = lambda n: n / (seconds * 1e9) if seconds > 0 else 0.0
        lines = [
            f"joins {self.joins}: build {self.build_rows}, probe {self.probe_rows}, out {self.out_rows} rows, {self.out_cells} cells, selectivity {self.selectivity:.4f}, {self.columns_per_row:.2f} columns a row",
            f"{seconds * 1000:.1f} ms, {rate(self.bytes_baseline_min):.2f} to {rate(self.bytes_likely):.2f} GB/s",
        ]
        for name, n in (("least", self.bytes_baseline_min), ("likely", self.bytes_likely)):
            lines.append(f"{name} {n / 2**30:.3f} GiB: " + ", ".join(f"{ms:.2f} ms at {r:.0f} GB/s" for ms, r in zip(self.bounds_ms(n), RATES_GB_S, strict=True)))
        return "\n".join(lines)


@dataclass
class Telemetry:
    """Watches a plan's joins through observations; read ``totals`` after the result has been computed.

    Observations count the rows that pass, so a side that Catalyst prunes is counted as pruned.
    """

    seen: dict[int, dict[str, tuple[Observation, int]]] = field(default_factory=dict)
    began: float = field(default_factory=time.perf_counter)

    def _watch(self, join: int, what: str, df: DataFrame) -> DataFrame:
        o = Observation()
        self.seen.setdefault(join, {})[what] = (o, len(df.columns))
        return df.observe(o, F.count(F.lit(1)).alias("n"))

    def side(self, join: int, df: DataFrame, build: bool) -> DataFrame:
        return self._watch(join, "build" if build else "probe", df)

    def result(self, join: int, df: DataFrame) -> DataFrame:
        return self._watch(join, "out", df)

    def totals(self) -> Totals:
        out = Totals()
        for got in self.seen.values():
            rows = {k: int(o.get.get("n", 0)) for k, (o, _) in got.items()}
            out.add(rows["build"], rows["probe"], rows["out"], got["out"][1])
        return out

    def report(self) -> str:
        return self.totals().report(time.perf_counter() - self.began)
