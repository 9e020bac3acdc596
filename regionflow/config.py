"""All parameters of the analytics, as one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # genome
    tile: int = 250
    block: int = 800_000
    min_ref_cpg: int = 2
    # coverage of a site, both ends as each operator states
    min_cov: int = 10
    max_cov: int = 200
    # region labels
    min_cpg: int = 3
    min_reads: int = 20
    max_p: float = 0.05
    max_bh: float = 0.05
    min_effect: float = 0.2
    min_sig_cpg: int = 3
    min_consecutive: int = 2
    # features
    read_share: float = 0.5
    extreme_reads: int = 10
    matrix_cpg: int = 10
    pad: int = 10
    ratio_grid: tuple[float, float, float] = (0.0, 1.0, 0.1)
    cov_grid: tuple[float, float, float] = (0.0, 200.0, 10.0)
    ratio_bandwidth: float = 0.1
    cov_bandwidth: float = 5.0
    # sequence models
    states: int = 4
    restarts: int = 5
    iterations: int = 100
    # points that a search draws from its grid; strengths and penalties of logistic regressions
    draws: int = 50
    lr_strengths: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
    lr_penalties: tuple[str, ...] = ("l1", "l2")
    # sample -> dataset
    datasets: dict[str, str] = field(default_factory=lambda: {"S0": "TRAINING", "S1": "VALIDATION", "S2": "TESTING"})


DEFAULT = Config()

# Lengths of the human autosomes 1 to 22, build hg19.
AUTOSOME_LENGTHS = (
    249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516,
    133851895, 115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566,
)
