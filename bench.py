"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from latticeloom.plans import load_queries  # noqa: E402
from latticeloom.session import get_session  # noqa: E402

HEADLINE = [
    "A1_lowest_rows", "A2_phase_differences", "A4_selected_phase_pairs", "A5_binary_energy_differences",
    "J2_differences_joined_to_energies", "Q4_first_after_sort", "Q7_label_encoding", "G4_uniform_bins", "G5_quantile_bins",
    "Q8_batches", "Q9_stratified_split", "P5_symmetry_filter", "P7_duplicates", "P8_rare_species", "J5_element_properties",
    "E1_atomic_feature_table", "A21_hill_formula", "E2_combined_features", "A10_transition_aggregate",
    "A12_committee_uncertainty", "Q1_top_classes", "A23_top_filters", "M1_cosine_similarity", "J10_cross_similarity",
    "N1_standardised_columns", "A26_convex_hulls", "E4_pair_subsets", "N4_principal_components", "E8_kmeans", "E10_dbscan",
    "J6_open_neighbour_pairs", "J7_periodic_pairs", "A27_minimum_distance", "G3_length_scale", "G2_pair_design_matrix",
    "J18_common_neighbours", "G9_environment_spectrum", "J8_atoms_in_boxes", "A16_population_statistics", "V1_supercell",
    "V6_vacancies", "S1_xyz_round_trip", "K10_sparse_matrix", "E17_descriptor_job",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_queries().QUERIES
    spark.read.parquet(f"{folder}/lineitem.parquet").count()          # start the workers
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
