"""Registered queries of this subpackage."""

from __future__ import annotations

from .ann import op4_learned_partitions
from .collocations import op11_collocations
from .debruijn import op12_debruijn
from .mixing import op1_pareto_mix
from .neardup import op8_minhash
from .packing import op7_pack
from .pii import op10_weak_pii
from .quality import op2_bayes_quality
from .repeats import op9_repeated_passages
from .rules import op6_host_rules
from .suffixtree import op5_suffix_tree
from .wavelet import op3_wavelet_corpus
from .whitening import op13_whitening

QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_bayes_quality": op2_bayes_quality,
    "op3_wavelet_corpus": op3_wavelet_corpus,
    "op4_learned_partitions": op4_learned_partitions,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_host_rules": op6_host_rules,
    "op7_pack": op7_pack,
    "op8_minhash": op8_minhash,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_weak_pii": op10_weak_pii,
    "op11_collocations": op11_collocations,
    "op12_debruijn": op12_debruijn,
    "op13_whitening": op13_whitening,
}
