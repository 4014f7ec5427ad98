"""Settings of a mapping run, one frozen set a mode."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class MapperConfig:
    """Limits of the search. Gap limits are always explicit; a mismatch count of -1 means the share of the length."""

    mode: str
    filter_min_matches: int
    max_gap_length: int
    max_gap_count: int
    confident_anchor: int
    min_diagonal_span: int
    intron_length_min: int = 20
    max_mismatch_count: int = -1
    max_mismatch_share: float = 0.1
    min_initial_share: float = 0.55
    confident_mismatches: int = 6
    confident_delta: int = 100
    confident_window: int = 10
    max_branching_depth: int = 30
    sam_use_x: bool = True
    sam_include_all_pairings: bool = False

    def dump(self) -> str:
        return "".join(f"{k}: {str(v).lower() if isinstance(v, bool) else v}\n" for k, v in asdict(self).items())


DNA = MapperConfig("dna", filter_min_matches=7, max_gap_length=1000, max_gap_count=1, confident_anchor=50, min_diagonal_span=50)
RNA = MapperConfig("rna", filter_min_matches=6, max_gap_length=500_000, max_gap_count=20, confident_anchor=20, min_diagonal_span=20)
