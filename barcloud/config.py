"""Platform registry, numeric constants and the skew policy shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: these must equal the documented ones for results to match. ---
BC_LEN = 16                 # barcode bases at the start of mate 1 (count / preproc)
MATE1_TRIM = 7              # bases trimmed after the barcode
MIN_READ_SIZE = 32          # shorter mate-1 reads drop the pair
PHRED_OFFSET = 33
MAX_QUAL = 33               # barcode qualities saturate here
CONFIDENCE = 0.975          # posterior ratio needed to accept a correction
EM_ROUNDS = 5
EM_MIN_PAIRS = 30
INSERT_MIN = -35
INSERT_MAX = 750
UNPAIRED_PENALTY = -15.0
INDEL_RATE = 1e-4
CLIP_RATE = 0.03
EXTRA_SEARCH_DEPTH = 12
SPLIT_EXTRA_SEARCH_DEPTH = 5
SECONDARY_THRESHOLD = 0.9
GAMMA_FLOOR = 1e-50
DENSITY_BIN = 1000
DENSITY_SCORE_SCALE = 20.0
DENSITY_MIN_RECORDS = 6
HAPLOTAG_SEGMENT_MAX = 96
# --- end of fixed values ---

DENSITY_ROUNDS = 3          # of the set-based density ascent; our own choice

NOCHANGE, H1CHANGE, H2CHANGE, NOBUCKET = "NOCHANGE", "H1CHANGE", "H2CHANGE", "NOBUCKET"

# chrom and pos are folded in one sortable LONG: chrom * GENOME_STRIDE + pos
GENOME_STRIDE = 1 << 33


@dataclass(frozen=True)
class Platform:
    """Run-time profile of a sequencing platform."""

    name: str
    bc_len: int
    many_clouds: bool
    dist_thresh: int
    error_rate: float
    density_probs: tuple[float, ...]

    def __post_init__(self):
        # The mate search relies on every in-window partner being in the same cloud.
        if self.dist_thresh < INSERT_MAX:
            raise ValueError(f"dist_thresh must be at least {INSERT_MAX}")


# Platform profiles.
_DENSITY = (0.6, 0.05, 0.2, 0.01)
_DENSITY_CPT = (0.6, 0.01, 0.15, 0.001, 0.05, 0.001, 0.02, 0.001, 0.01)
PLATFORMS = {
    p.name: p
    for p in (
        Platform("10x", 16, False, 50_000, 0.001, _DENSITY),
        Platform("haplotag", 12, False, 50_000, 0.001, _DENSITY),
        Platform("tru", 0, True, 15_000, 0.001, _DENSITY),
        Platform("cpt", 0, True, 3_500, 0.01, _DENSITY_CPT),
        Platform("dbs", 20, False, 50_000, 0.001, _DENSITY),
        Platform("tellseq", 18, False, 50_000, 0.001, _DENSITY),
    )
}
DEFAULT_PLATFORM = "10x"


def get_platform(name: str) -> Platform:
    try:
        return PLATFORMS[name]
    except KeyError:
        raise ValueError(f"platform '{name}' is not one of {', '.join(PLATFORMS)}") from None


@dataclass(frozen=True)
class SkewPolicy:
    """When is a key too heavy for one task?

    A key is heavy when it has more rows than
    ``max(max_group_rows, total_rows / max_heavy_keys)``.  At most ``max_heavy_keys`` keys can
    exceed that share, so a table holding one row per heavy key has a proven bound and may be
    broadcast whatever the size of the data.
    """

    # a window chain of the alignment stage takes up to 7 KB of a task's memory a row
    max_group_rows: int = 350_000
    max_heavy_keys: int = 50_000
    # whitelists up to this many barcodes are broadcast, larger ones use shuffle joins
    max_broadcast_rows: int = 8_000_000
    target_file_rows: int = 4_000_000
    rows_per_task: int = 100_000
    waves: int = 4
    # numbers of tasks tried for an even placement of barcodes
    placements: int = 32

    def threshold(self, total_rows: int) -> int:
        return max(self.max_group_rows, total_rows // self.max_heavy_keys)


DEFAULT_POLICY = SkewPolicy()
