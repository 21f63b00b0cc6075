"""corpusprep: Spark-native parallel-corpus preparation and translation evaluation.

Every operator takes and returns DataFrames; see README.md for the inventory.
"""

__version__ = "0.1.0"

from corpusprep.functions.text import (detokenise, lowercase, normalise_ws, run_of, split_punctuation,  # noqa: F401
                                       step_of, tokens, truncate_tokens)
from corpusprep.operators.align import (align_by_key, alignment_rejects, last_per_key,  # noqa: F401
                                        pending_batches, zip_lines)
from corpusprep.operators.batching import collect_batches, fixed_batches, flatten_batches  # noqa: F401
from corpusprep.operators.bpe_apply import apply_bpe, apply_bpe_groups, bpe_stats, subword_vocab  # noqa: F401
from corpusprep.operators.bpe_learn import (best_pair, learn_bpe, learn_bpe_from_counts, merge_trace,  # noqa: F401
                                            pair_counts, word_types)
from corpusprep.operators.budget import batch_summary, budget_batches, token_batches  # noqa: F401
from corpusprep.operators.experiments import (config_grid, dedupe_configs, freeze, must_include,  # noqa: F401
                                              plan_experiments, render_template, resolve_links,
                                              sample_configs)
from corpusprep.operators.external import (build_prompt, clean_numbered, map_batches, rewrite_lines,  # noqa: F401
                                           run_resumable, to_pairs)
from corpusprep.operators.logs import best_per_run, extract_metrics, report, summarise_runs, with_ordinal  # noqa: F401
from corpusprep.operators.metrics import compare_scores, corpus_bleu, corpus_chrf, score_runs  # noqa: F401
from corpusprep.operators.stats import build_vocab, corpus_stats, vocab_by_freq, word_counts  # noqa: F401
from corpusprep.operators.variants import build_variants, concat_corpora, drop_empty_pairs, normalise_pairs  # noqa: F401
from corpusprep.sources.lines import (parse_keyed_lines, parse_merges, parse_records, parse_vocab,  # noqa: F401
                                      parse_word_counts, read_keyed_tsv, read_lines, read_logs, read_merges,
                                      read_predictions, read_vocab, read_word_counts)
from corpusprep.sources.sinks import write_dataset, write_merges, write_parallel, write_scores  # noqa: F401
