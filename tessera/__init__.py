"""tessera: profile, sample, anonymise, reduce and report on tables with Spark."""

__version__ = "0.1.0"

from tessera.functions.textbars import sparkline
from tessera.operators.allocate import allocate
from tessera.operators.anonymize import Anonymizer, MappingAnonymizer, Names, anonymize, make_anonymizer, suggest_ethnicity_mapping, suggest_gender_mapping
from tessera.operators.names import NameLibrary, library, use_library
from tessera.operators.profile import ColumnStats, profile, profile_table
from tessera.operators.reduce import ReductionResult, reduce_columns
from tessera.operators.report import format_distribution, format_histograms, format_reduction_report, format_stratification_report, histogram_comparison, snippet, stratification_table, unrepresented
from tessera.operators.sample import SampleResult, random_sample, sample, stratified_sample, stratum_sizes
from tessera.operators.strata import find_stratification_columns
from tessera.plans.plan import TYPE_OPTIONS, AnonymizationPlan, suggest_type
from tessera.sources.readers import SUPPORTED_EXTENSIONS, list_sheets, read_table, resolve, row_count
from tessera.sources.writers import save_output, save_report, tag, write_table
from tessera.streaming.anonymize import anonymize_stream

__all__ = [
    "SUPPORTED_EXTENSIONS", "TYPE_OPTIONS", "AnonymizationPlan", "Anonymizer", "ColumnStats", "MappingAnonymizer", "NameLibrary", "Names", "ReductionResult", "SampleResult",
    "allocate", "anonymize", "anonymize_stream", "find_stratification_columns", "format_distribution", "format_histograms", "format_reduction_report", "format_stratification_report",
    "histogram_comparison", "library", "list_sheets", "make_anonymizer", "profile", "profile_table", "random_sample", "read_table", "reduce_columns", "resolve", "row_count", "sample",
    "save_output", "save_report", "snippet", "sparkline", "stratification_table", "stratified_sample", "stratum_sizes", "suggest_ethnicity_mapping", "suggest_gender_mapping", "suggest_type",
    "tag", "unrepresented", "use_library", "write_table",
]
