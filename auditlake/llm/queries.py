"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from .decontaminate import OP10_SQL, op10_decontaminate
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .jaccard_join import OP5_SQL, op5_jaccard_join
from .licenses import OP9_PLACES_SQL, op9_license_places, op9_licenses
from .mixing import OP6_OVERLAP_SQL, OP6_TARGETS_SQL, op6_mix_overlap, op6_mix_targets, op6_mixing
from .quality import op2_quality
from .secrets import OP8_COUNTS_SQL, op8_secret_counts, op8_secrets
from .sharding import OP7_SIZES_SQL, op7_shard_sizes, op7_sharding
from .spelling import OP11_SQL, op11_spelling
from .suffix_repeats import OP12_SQL, op12_suffix_repeats
from .tool_calls import OP1_SQL, OP1_STRICT_SQL, op1_tool_calls, op1_tool_calls_strict
from .url_filter import OP3_JUNK_SQL, OP3_SQL, op3_url_filter, op3_url_filter_junk

QUERIES = {
    "op1_tool_calls": op1_tool_calls,
    "op1_tool_calls_strict": op1_tool_calls_strict,
    "op2_quality": op2_quality,
    "op3_url_filter": op3_url_filter,
    "op3_url_filter_junk": op3_url_filter_junk,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_mixing": op6_mixing,
    "op6_mix_targets": op6_mix_targets,
    "op6_mix_overlap": op6_mix_overlap,
    "op7_sharding": op7_sharding,
    "op7_shard_sizes": op7_shard_sizes,
    "op8_secrets": op8_secrets,
    "op8_secret_counts": op8_secret_counts,
    "op9_licenses": op9_licenses,
    "op9_license_places": op9_license_places,
    "op10_decontaminate": op10_decontaminate,
    "op11_spelling": op11_spelling,
    "op12_suffix_repeats": op12_suffix_repeats,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL = {
    "op1_tool_calls": OP1_SQL,
    "op1_tool_calls_strict": OP1_STRICT_SQL,
    "op3_url_filter": OP3_SQL,
    "op3_url_filter_junk": OP3_JUNK_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op6_mix_targets": OP6_TARGETS_SQL,
    "op6_mix_overlap": OP6_OVERLAP_SQL,
    "op7_shard_sizes": OP7_SIZES_SQL,
    "op8_secret_counts": OP8_COUNTS_SQL,
    "op9_license_places": OP9_PLACES_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_spelling": OP11_SQL,
    "op12_suffix_repeats": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
