"""Queries of the training-data operators, with SQL where it can express them."""

from matchday.llm import (classifier, collocations, divergence, html_text, license_scan, mixing, packing, pivots, rules,
                          secret_scan, simhash, substrings, suffixes)

QUERIES = {fn.__name__: fn for fn in (
    mixing.op1_source_mix, html_text.op2_host_suffix_array, license_scan.op3_license_scan, rules.op4_quality_rules,
    simhash.op5_simhash, packing.op6_cutting_stock, secret_scan.op7_secret_scan, substrings.op8_count_min,
    classifier.op9_factorisation_machine, pivots.op10_pivot_permutation, collocations.op11_phrase_stripes,
    suffixes.op12_suffix_groups, divergence.op13_source_divergence)}
SQL = {"op1_source_mix": mixing.OP1_SQL, "op11_phrase_stripes": collocations.OP11_SQL,
       "op13_source_divergence": divergence.OP13_SQL}
