"""Queries of this subpackage for the driver, and their SQL where SQL can say them."""

from __future__ import annotations

from .bagminhash import op7_bagminhash
from .bpe import op4_rank_queue_bpe
from .licences import op5_canonical_digest, op5_sql
from .line_frequency import OP2_SQL, op2_line_frequency
from .packing import op8_shortest_pack_first
from .pivots import op6_pivot_permutation
from .planes import op1_bit_planes
from .quality import op3_hierarchical_bayes
from .toxicity import op9_string_kernel
from .warc import op10_boundary_chain

QUERIES = {
    f.__name__: f
    for f in (
        op1_bit_planes,
        op2_line_frequency,
        op3_hierarchical_bayes,
        op4_rank_queue_bpe,
        op5_canonical_digest,
        op6_pivot_permutation,
        op7_bagminhash,
        op8_shortest_pack_first,
        op9_string_kernel,
        op10_boundary_chain,
    )
}
SQL = {"op2_line_frequency": OP2_SQL, "op5_canonical_digest": op5_sql()}
