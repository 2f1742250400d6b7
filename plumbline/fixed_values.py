"""Names and numbers that must equal the published data contract."""

# ---- fixed values: trace files and splits -------------------------------
SPLITS = ("train", "val", "test")
REQUIRED_FILES = (
    "candidate_cuts.csv",
    "applied_cuts.csv",
    "lp_states.csv",
    "sep_round_transitions.csv",
    "summary.json",
    "scip_statistics.txt",
)
TRUE_WORDS = ("1", "true", "yes")
SCAN_MISSING_COLUMNS = (
    "cut_id",
    "cut_name",
    "origin_type",
    "rank",
    "score",
    "nnz",
    "rhs",
    "lhs",
    "constant",
    "coeff_norm_l2",
    "coeff_norm_l1",
    "coeff_max_abs",
    "coeff_min_abs",
    "coeff_mean_abs",
    "coeff_std_abs",
    "coeff_sparsity_ratio",
    "efficacy",
    "obj_parallelism",
    "cutoff_distance",
    "n_int_cols",
)
IGNORED_FAMILY_KEYS = ("", "a", "m", "neos", "ns", "s")
EXPECTED_UNITS = 233

# ---- fixed values: decision and candidate tables ------------------------
SIGNATURE_FIELDS = (
    "cut_name",
    "origin_type",
    "score",
    "nnz",
    "rhs",
    "lhs",
    "constant",
    "coeff_norm_l2",
    "coeff_norm_l1",
    "coeff_max_abs",
    "coeff_min_abs",
    "coeff_mean_abs",
    "coeff_std_abs",
    "efficacy",
    "obj_parallelism",
    "cutoff_distance",
    "n_int_cols",
    "is_local",
    "is_modifiable",
    "is_removable",
    "is_integral",
    "in_global_cutpool",
)
PRE_STATE_FIELDS = (
    "pre_lp_status",
    "n_lp_rows_pre",
    "n_lp_cols_pre",
    "lp_obj_val_pre",
    "lp_iterations_total_pre",
    "lp_iterations_node_pre",
    "dual_bound_pre",
    "primal_bound_pre",
    "gap_pre",
    "n_cuts_applied_pre",
    "n_cuts_generated_node_pre",
    "n_open_nodes_pre",
)
ROUND_FIELDS = (
    "sep_round_run",
    "sep_round_global",
    "lp_round_node",
    "lp_round_run",
    "lp_round_global",
)
BOOLEAN_FEATURES = (
    "cutoff_distance_available",
    "is_local",
    "is_modifiable",
    "is_removable",
    "is_integral",
    "in_global_cutpool",
    "pre_state_available",
)
CATEGORICAL_FEATURES = ("origin_type", "pre_lp_status")
PROHIBITED_FIELDS = (
    "rank",
    "is_selected",
    "is_forced",
    "is_applied",
    "observed_logical_is_applied",
    "original_index",
    "lp_position",
    "coeff_sparsity_ratio",
    "solving_time",
    "post_lp_status",
    "n_lp_rows_post",
    "n_lp_cols_post",
    "lp_obj_val_post",
    "delta_lp_obj_val",
    "lp_obj_improvement_ratio",
    "delta_lp_iterations_total",
    "dual_bound_post",
    "delta_dual_bound",
    "primal_bound_post",
    "delta_primal_bound",
    "gap_post",
    "delta_gap",
    "relative_gap_improvement",
    "n_cuts_applied_post",
    "delta_n_cuts_applied",
)
SUBSETS = (
    "train",
    "official_group_ood_val",
    "official_group_ood_test",
    "seen_family_val",
    "seen_family_test",
    "officially_ungrouped_val",
    "officially_ungrouped_test",
)
UNKNOWN_CATEGORY = "<UNK>"
ORIGIN_NAMES = {1: "CONSHDLR", 2: "CONS", 3: "SEPA"}
TOP_K_CAPTURE = (1, 5, 10, 20)

# ---- fixed values: paired experiments -----------------------------------
COMPLETE_STATUSES = ("optimal", "infeasible", "unbounded", "inforunbd")
STRUCTURAL_INTEGER_FIELDS = ("nodes", "total_nodes", "lp_iterations", "lp_count", "cuts_applied")
STRUCTURAL_FLOAT_FIELDS = ("primal_bound", "dual_bound", "gap")
PAIR_METRICS = (
    "nodes",
    "total_nodes",
    "lp_iterations",
    "lp_count",
    "cuts_applied",
    "solving_time",
    "arm_wall_time_seconds",
    "primal_dual_integral",
)
DESCRIPTIVE_METRICS = (
    "nodes",
    "total_nodes",
    "lp_iterations",
    "lp_count",
    "cuts_applied",
    "primal_dual_integral",
)
FORBIDDEN_CONTEXT_KEYS = (
    "outcome",
    "solving_time",
    "primal_dual_integral",
    "final_status",
    "final_primal_bound",
    "final_dual_bound",
)
INTERVENTION_SCOPES = ("per-run", "first-run-only")
TIE_TOLERANCE = 1e-12
CLOSE_TOLERANCE = 1e-9

# ---- fixed values: score weights ----------------------------------------
POOL_BONUS = 1e-4
ADAPTIVE_WEIGHTS = {"distance": 0.0, "efficacy": 1.0, "integer": 0.1, "parallelism": 0.1}
