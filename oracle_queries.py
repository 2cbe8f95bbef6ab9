"""DuckDB SQL that computes the registered queries on the same tables.

Written apart from the operators: a run is labelled by ordered rules that
``_first`` turns into one expression, and each study figure is one filtered
aggregate over the labelled runs.
"""

from __future__ import annotations

from fixture_views import RAW_COLUMNS, RECORD_VIEW, RUN_VIEW
from runsieve.functions import vocabulary as v


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_text(pattern)})"


def _term(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, {_text(pattern)}), '')"


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"coalesce({column} IN ({', '.join(map(_text, values))}), false)"


def _first(rules: list[tuple[str, str]], default: str = "NULL") -> str:
    """The label of the first rule that holds."""
    whens = " ".join(f"WHEN {condition} THEN {_text(label)}" for label, condition in rules)
    return f"CASE {whens} ELSE {default} END"


def _spaced(*columns: str) -> str:
    return " || ' ' || ".join(columns)


def _with(*ctes: str, select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


# --- runs and their texts -------------------------------------------------

_KEYED = {
    "disease_state": "a_disease",
    "strain": "a_strain",
    "tissue": "a_tissue",
    "growth_media": "a_media",
}
_PAIRS = ", ".join(f"{{'k': '{k}', 'v': {c}}}" for k, c in _KEYED.items())
_METADATA = f"metadata AS (SELECT *, [{_PAIRS}] AS attributes FROM ({RUN_VIEW}))"


def _blob(attributes: str) -> str:
    pairs = f"list_transform({attributes}, lambda a: a.k || '=' || a.v)"
    told = f"list_filter({pairs}, lambda pair: pair IS NOT NULL)"
    return f"lower(array_to_string({told}, ' | '))"


_SCOPED = f"list_filter(attributes, lambda a: {_has('lower(a.k)', v.LABEL_KEYS)})"
_NEGATED = rf"non[-_ ]?({v.NEGATED_TERMS})\b"
_TISSUE_KEY = rf"^[^=]*({v.TISSUE_KEYS})[^=]*="
_TISSUE_PARTS = (
    "list_filter(string_split(attr_blob, ' | '), lambda part: "
    f"{_has('part', _TISSUE_KEY)})"
)
_TEXTS = f"""texts AS (
  SELECT *,
    lower(coalesce(library_name, '')) AS lib_lc,
    lower(coalesce(libraryselection, '')) AS libsel_lc,
    {_blob("list_sort(attributes)")} AS attr_blob,
    {_blob(_SCOPED)} AS scoped_blob,
    regexp_replace(scoped_blob, {_text(v.DIET_PHRASE)}, ' ', 'g') AS blanked_blob,
    regexp_replace(blanked_blob, {_text(_NEGATED)}, '{v.NEGATION_TOKEN}', 'g') AS label_blob,
    array_to_string(list_sort({_TISSUE_PARTS}), ' | ') AS tissue_blob
  FROM metadata)"""
_ANCHORS = f"""anchors AS (
  SELECT bioproject FROM texts
  WHERE consent = 'public' AND {_one_of("organism", v.ORGANISMS)}
    AND {_has("label_blob", v.CASE_TERMS)}
  GROUP BY bioproject)"""
_RUNS = """runs AS (
  SELECT texts.* FROM texts SEMI JOIN anchors USING (bioproject) WHERE consent = 'public')"""
_UP_TO_RUNS = (_METADATA, _TEXTS, _ANCHORS, _RUNS)

# --- run labels -----------------------------------------------------------

_ASSAY, _SOURCE = "lower(coalesce(assay_type, ''))", "lower(coalesce(librarysource, ''))"
_CELL_WORDS = _has(_spaced("attr_blob", "lib_lc", "libsel_lc"), v.SINGLE_CELL_TERMS)
_CELL_SOURCE = f"{_SOURCE} = '{v.SINGLE_CELL_SOURCE}'"
_SMALL_LIBRARY = _has(_spaced("lib_lc", "libsel_lc"), v.SMALL_RNA_TERMS)
_SMALL_ASSAY = _one_of(_ASSAY, v.SMALL_RNA_ASSAYS)
_GENERAL_ASSAY = _one_of(_ASSAY, v.GENERAL_RNA_ASSAYS)

_TISSUE = _first(
    [
        *((name, _has("tissue_blob", pattern)) for name, pattern in v.TISSUE_CLASSES),
        ("unannotated", "tissue_blob = ''"),
    ],
    "'other'",
)
_EVIDENCE = _first(
    [
        ("assay_declared", _SMALL_ASSAY),
        ("library_declared", _SMALL_LIBRARY),
        ("attribute_mentioned", _has("attr_blob", v.SMALL_RNA_TERMS)),
        ("readlen_inferred", f"{_GENERAL_ASSAY} AND 15 <= avgspotlen AND avgspotlen <= 51"),
    ]
)
_LABELLED = f"""labelled AS (
  SELECT *,
    {_term("label_blob", v.CASE_TERMS)} AS ad_term,
    {_term("label_blob", v.CONTROL_TERMS)} AS ctrl_term,
    {_has("label_blob", v.CASE_TERMS)} AS ad_hit,
    {_has("label_blob", v.CONTROL_TERMS)} AS ctrl_hit,
    {_CELL_WORDS} AS single_cell, {_EVIDENCE} AS srna_evidence, {_TISSUE} AS tissue_class
  FROM runs)"""

_LIBRARY = _spaced("lib_lc", "attr_blob")
_PRIMING = _first(
    [
        ("random_declared", _one_of("libsel_lc", v.RANDOM_SELECTIONS)),
        (
            "ribodep_declared",
            f"starts_with(libsel_lc, '{v.DEPLETION_SELECTION_PREFIX}')",
        ),
        ("polya_declared", _one_of("libsel_lc", v.POLYA_SELECTIONS)),
        ("random_or_ribodep_text", _has(_LIBRARY, v.DEPLETION_TERMS)),
        ("polya_text", _has(_LIBRARY, v.POLYA_TERMS)),
        ("unspecified", _one_of("libsel_lc", v.OPEN_SELECTIONS)),
    ],
    "'other_selection'",
)
_READ = _first(
    [
        ("long_declared", _one_of("upper(platform)", v.LONG_READ_PLATFORMS)),
        (
            "long_text",
            _has(f"lower(coalesce(instrument, '')) || ' ' || {_LIBRARY}", v.LONG_READ_TERMS),
        ),
        ("long_inferred", "avgspotlen > 599"),
    ],
    "'short_read'",
)
_RNA = _first(
    [
        ("small_rna", f"{_SMALL_ASSAY} OR {_SMALL_LIBRARY}"),
        (
            "not_rna",
            f"NOT ({_GENERAL_ASSAY} OR starts_with({_SOURCE}, '{v.RNA_SOURCE_PREFIX}'))",
        ),
        (
            "total_rna_random",
            "priming_class IN ('random_declared', 'ribodep_declared', 'random_or_ribodep_text')",
        ),
        ("polya_mrna", "priming_class IN ('polya_declared', 'polya_text')"),
    ],
    "'rna_unspecified'",
)


def _target_runs(
    any_organism: bool = False, long_inferred: bool = False, unspecified: bool = False
) -> str:
    long = ("long_declared", "long_text") + (("long_inferred",) if long_inferred else ())
    wanted = [
        "rna_class = 'total_rna_random'",
        f"({_one_of('read_class', long)} AND rna_class NOT IN ('small_rna', 'not_rna'))",
    ]
    if unspecified:
        wanted.append(
            "coalesce(rna_class = 'rna_unspecified' AND "
            "librarysource = 'TRANSCRIPTOMIC' AND assay_type = 'RNA-Seq', false)"
        )
    where = "true" if any_organism else _one_of("organism", v.ORGANISMS)
    silent = (
        f"NOT {_has('label_blob', v.CASE_TERMS)} AND NOT {_has('label_blob', v.CONTROL_TERMS)}"
    )
    return f"""target_runs AS (
  SELECT *,
    label_blob || CASE WHEN {silent} THEN ' ' || lib_lc ELSE '' END AS label_eff,
    {_term("label_eff", v.CASE_TERMS)} AS ad_term,
    {_term("label_eff", v.CONTROL_TERMS)} AS vocabulary_control,
    {_term("label_eff", v.STRAIN_TERMS)} AS strain_control,
    coalesce(vocabulary_control, CASE WHEN ad_term IS NULL THEN strain_control END) AS ctrl_term,
    ad_term IS NOT NULL AS ad_hit, ctrl_term IS NOT NULL AS ctrl_hit,
    {_CELL_WORDS} OR {_CELL_SOURCE} AS single_cell,
    {_PRIMING} AS priming_class, {_READ} AS read_class, {_RNA} AS rna_class,
    {_TISSUE} AS tissue_class,
    ({" OR ".join(wanted)}) AND NOT single_cell AS is_target
  FROM runs WHERE {where})"""


# --- study figures --------------------------------------------------------

_KEYS = "bioproject, sra_study, organism"
_LATEST = "strftime(max(releasedate), '%Y-%m-%d %H:%M:%S.%f UTC') AS latest_release"


def _cell(name: str, value: str, within: str = "true", slice_: str = "") -> str:
    values = f"list(DISTINCT {value}) FILTER ({within} AND {value} IS NOT NULL)"
    joined = f"array_to_string(list_sort({values}){slice_}, ',')"
    return f"'[' || coalesce({joined}, '') || ']' AS {name}"


def _figures(conditions: dict[str, str], within: str = "true") -> str:
    return ", ".join(
        f"count(*) FILTER ({within} AND {condition}) AS {name}"
        for name, condition in conditions.items()
    )


def _equals(column: str, names: dict[str, str]) -> dict[str, str]:
    return {name: f"{column} = '{value}'" for name, value in names.items()}


_ARMS = {
    "case_only": "(ad_hit, ctrl_hit) = (true, false)",
    "control_only": "(ad_hit, ctrl_hit) = (false, true)",
    "ambiguous": "(ad_hit, ctrl_hit) = (true, true)",
    "unlabeled": "(ad_hit, ctrl_hit) = (false, false)",
}
_TARGET_TISSUES = {
    **_equals(
        "tissue_class",
        {
            "n_prefrontal": "brain_prefrontal",
            "n_hippocampal": "brain_hippocampal",
            "n_brain_other": "brain_other",
            "n_csf": "csf",
            "n_biofluid": "biofluid",
            "n_cell_model": "cell_model",
            "n_tissue_unannotated": "unannotated",
        },
    ),
    "n_brain_any": "starts_with(tissue_class, 'brain')",
}
_TISSUES = {**_TARGET_TISSUES, "n_tissue_other": "tissue_class = 'other'"}
_TIERS = {
    **_equals(
        "srna_evidence",
        {
            "n_assay_declared": "assay_declared",
            "n_library_declared": "library_declared",
            "n_attr_mentioned": "attribute_mentioned",
            "n_readlen_inferred": "readlen_inferred",
        },
    ),
    "n_single_cell": "single_cell",
}
_INVENTORY = {
    **_equals(
        "rna_class",
        {
            "n_total_rna_random": "total_rna_random",
            "n_polya_mrna": "polya_mrna",
            "n_small_rna": "small_rna",
            "n_rna_unspecified": "rna_unspecified",
            "n_not_rna": "not_rna",
        },
    ),
    "n_long_read": "read_class IN ('long_declared', 'long_text')",
    "n_long_inferred": "read_class = 'long_inferred'",
    "n_single_cell": "single_cell",
}
_PRIMED = _equals(
    "priming_class",
    {
        "n_random_declared": "random_declared",
        "n_ribodep_declared": "ribodep_declared",
        "n_random_text": "random_or_ribodep_text",
        "n_priming_unspecified": "unspecified",
    },
)

_STUDIES = f"""studies AS (
  SELECT {_KEYS}, count(*) AS n_runs, count(DISTINCT biosample) AS n_biosamples,
    {_figures(_ARMS)}, {_figures(_TIERS)}, {_figures(_TISSUES)},
    {_cell("ad_terms", "ad_term")}, {_cell("ctrl_terms", "ctrl_term")},
    {_cell("tissue_classes", "tissue_class")}, {_cell("assay_types", "assay_type")},
    quantile_disc(avgspotlen, 0.5) AS median_readlen,
    round(sum(mbytes)::DOUBLE / count(*) / 1024, 3) AS gb_per_run,
    round(sum(mbytes)::DOUBLE / 1024, 1) AS total_gb, {_LATEST}
  FROM labelled GROUP BY ALL)"""
_TARGET_STUDIES = f"""studies AS (
  SELECT {_KEYS}, count(*) AS n_runs_total, {_figures({"n_target_runs": "is_target"})},
    count(DISTINCT biosample) FILTER (is_target) AS n_target_biosamples,
    {_figures(_ARMS, "is_target")}, {_figures(_INVENTORY)},
    {_figures(_PRIMED, "is_target")}, {_figures(_TARGET_TISSUES, "is_target")},
    {_cell("target_librarysources", "librarysource", "is_target")},
    {_cell("target_selections", "libraryselection", "is_target")},
    {_cell("target_assay_types", "assay_type", "is_target")},
    {_cell("target_platforms", "platform", "is_target")},
    {_cell("target_instruments", "instrument", "is_target")},
    {_cell("target_library_names", "library_name", "is_target", "[1:8]")},
    {_cell("ad_terms", "ad_term")}, {_cell("ctrl_terms", "ctrl_term")},
    quantile_disc(avgspotlen, 0.5) FILTER (is_target) AS median_target_readlen,
    round(sum(CASE WHEN is_target THEN mbytes ELSE 0 END)::DOUBLE / 1024, 1) AS target_gb, {_LATEST}
  FROM target_runs GROUP BY ALL HAVING bool_or(is_target))"""


def _kept(
    arm: int = 3, longest: int = 120, min_size: float = 0.015, attributes: bool = False
) -> str:
    declared = "n_assay_declared + n_library_declared"
    if attributes:
        declared += " + n_attr_mentioned"
    return f"""kept AS (SELECT * FROM studies
  WHERE least(case_only, control_only) >= {arm} AND {declared} > 0 AND n_single_cell = 0
    AND median_readlen >= 15 AND median_readlen <= {longest} AND gb_per_run > {min_size})"""


def _tissue_details(source: str) -> str:
    return f"""tissues AS (
  SELECT bioproject, sra_study,
    array_to_string(list_sort(list(DISTINCT part))[1:6], ', ') AS tissue_attrs
  FROM (SELECT bioproject, sra_study, unnest(string_split(tissue_blob, ' | ')) AS part FROM {source})
  WHERE length(part) BETWEEN 1 AND 69 GROUP BY bioproject, sra_study)"""


def _cohort(samples: str, noun: str) -> str:
    return (
        f"format('{{}} {noun}: {{}} AD-like / {{}} control', {samples}, case_only, control_only)"
        " || CASE unlabeled WHEN 0 THEN '' ELSE format(' / {} other', unlabeled) END AS cohort_line"
    )


def _tissue_verdict(total: str) -> str:
    rules = [
        ("PREFRONTAL", "n_prefrontal > 0"),
        ("brain (other region)", "n_brain_any > 0"),
        ("unannotated - CHECK STUDY", f"n_tissue_unannotated = {total}"),
        ("biofluid/CSF only", "n_csf + n_biofluid > 0"),
    ]
    return f"{_first(rules, _text('other'))} AS tissue_verdict"


_ARM = "least(case_only, control_only) AS smaller_arm"
_LINKS = """'https://www.ncbi.nlm.nih.gov/bioproject/' || bioproject AS bioproject_url,
  'https://www.ncbi.nlm.nih.gov/Traces/study/?acc=' || sra_study AS run_selector_url"""
_SMALL_REPORT = f"""report AS (
  SELECT * EXCLUDE (n_attr_mentioned, n_readlen_inferred, n_single_cell, tissue_classes),
    {_cohort("n_biosamples", "samples")}, {_tissue_verdict("n_runs")}, {_ARM}, {_LINKS}
  FROM kept LEFT JOIN tissues USING (bioproject, sra_study))"""
_VERDICT = _first(
    [
        ("PASSES - real contrast", "smaller_arm >= 3"),
        ("thin - 2v2, underpowered", "smaller_arm = 2"),
        ("target arm unlabeled - CHECK BY HAND", "unlabeled = n_target_runs"),
    ],
    "'single-arm or too small'",
)
_BEST_EVIDENCE = _first(
    [
        ("libraryselection = RANDOM", "n_random_declared > 0"),
        ("libraryselection = Inverse rRNA", "n_ribodep_declared > 0"),
        ("long-read platform", "n_long_read > 0"),
        ("free text only - VERIFY", "n_random_text > 0"),
    ],
    "'weak'",
)
_TARGET_REPORT = f"""report AS (
  SELECT *, {_ARM}, {_VERDICT} AS verdict, {_BEST_EVIDENCE} AS evidence,
    {_cohort("n_target_biosamples", "target samples")}, {_tissue_verdict("n_target_runs")}, {_LINKS}
  FROM studies LEFT JOIN tissues USING (bioproject, sra_study))"""
_SMALL_RANK = "ORDER BY n_prefrontal DESC, n_brain_any DESC, smaller_arm DESC"
_TARGET_RANK = f"ORDER BY smaller_arm < 3, {_SMALL_RANK[9:]}, n_target_runs DESC"

# --- study records --------------------------------------------------------

# White space as the record cleaner sees it.
_SPACE = (
    r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}]+"
)


def _squeezed(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '{_SPACE}', ' ', 'g'))"


def _stripped(column: str) -> str:
    return f"regexp_replace(coalesce({column}, ''), '^{_SPACE}|{_SPACE}$', '', 'g')"


_RECORDS = f"""raw AS ({RECORD_VIEW}),
records AS (
  SELECT project_acc, {_stripped("project_title")} AS study_title,
    {_squeezed("project_description")}[:1200] AS study_description,
    {_stripped("submitter_organization")} AS submitter,
    {_stripped("registration_date")} AS registration_date,
    {_stripped("project_data_type")} AS project_data_type
  FROM raw QUALIFY row_number() OVER (PARTITION BY project_acc ORDER BY seq DESC) = 1)"""


def _flag(name: str, words: tuple[str, ...]) -> str:
    alternation = "|".join(words)
    return f"CASE WHEN {_has('told', alternation)} THEN 'True' ELSE 'False' END AS {name}"


_FILLED = ", ".join(
    f"coalesce({c}, '') AS {c}"
    for c in (
        "study_title",
        "study_description",
        "submitter",
        "registration_date",
        "project_data_type",
    )
)

# --- the queries ----------------------------------------------------------


def _over_texts(select: str) -> str:
    return _with(_METADATA, _TEXTS, select=select)


def _over_runs(select: str) -> str:
    return _with(*_UP_TO_RUNS, select=select)


def _over_labelled(select: str) -> str:
    return _with(*_UP_TO_RUNS, _LABELLED, select=select)


def _over_target(select: str) -> str:
    return _with(*_UP_TO_RUNS, _target_runs(), select=select)


def _kept_studies(**bounds: float) -> str:
    return _with(
        *_UP_TO_RUNS, _LABELLED, _STUDIES, _kept(**bounds), select="SELECT * FROM kept"
    )


def _small_screen(select: str) -> str:
    of_kept = "labelled SEMI JOIN kept USING (bioproject)"
    return _with(
        *_UP_TO_RUNS,
        _LABELLED,
        _STUDIES,
        _kept(),
        _tissue_details(of_kept),
        _SMALL_REPORT,
        select=select,
    )


def _target_screen(where: str = "true", **rules: bool) -> str:
    return _with(
        *_UP_TO_RUNS,
        _target_runs(**rules),
        _TARGET_STUDIES,
        _tissue_details("target_runs WHERE is_target"),
        _TARGET_REPORT,
        select=f"SELECT * FROM report WHERE {where} {_TARGET_RANK}",
    )


_NO_SIZE = -1


def _small_ladder() -> str:
    """Every screen of the ladder, and of each study the first report."""
    rungs = [
        {},
        {"min_size": _NO_SIZE},
        {"min_size": _NO_SIZE, "longest": 150},
        {"min_size": _NO_SIZE, "longest": 150, "attributes": True},
        {"min_size": _NO_SIZE, "longest": 150, "attributes": True, "arm": 2},
    ]
    screens = " UNION ALL ".join(
        "SELECT {} AS rung, * FROM ({})".format(
            at,
            _with(
                _kept(**bounds),
                _tissue_details("labelled SEMI JOIN kept USING (bioproject)"),
                _SMALL_REPORT,
                select="SELECT * FROM report",
            ),
        )
        for at, bounds in enumerate(rungs)
    )
    return _with(*_UP_TO_RUNS, _LABELLED, _STUDIES, select=_first_reports(screens))


def _first_reports(screens: str) -> str:
    return f"""SELECT * FROM ({screens})
QUALIFY rung = min(rung) OVER (PARTITION BY {_KEYS})"""


def _target_ladder() -> str:
    rungs = [
        {},
        {"long_inferred": True},
        {"long_inferred": True, "unspecified": True},
        {"long_inferred": True, "unspecified": True, "any_organism": True},
    ]
    screens = " UNION ALL ".join(
        "SELECT {} AS rung, * FROM ({})".format(
            at,
            _with(
                _target_runs(**rules),
                _TARGET_STUDIES,
                _tissue_details("target_runs WHERE is_target"),
                _TARGET_REPORT,
                select="SELECT * FROM report",
            ),
        )
        for at, rules in enumerate(rungs)
    )
    return _with(*_UP_TO_RUNS, select=_first_reports(screens))


ORACLES = {
    "attr_blob": _over_texts("SELECT acc, attr_blob FROM texts"),
    "scoped_blob": _over_texts("SELECT acc, scoped_blob FROM texts"),
    "negation_rewrite": _over_texts("SELECT acc, blanked_blob, label_blob FROM texts"),
    "anchor_scan": _with(_METADATA, _TEXTS, _ANCHORS, select="FROM anchors"),
    "study_runs": _over_runs(
        """SELECT bioproject, sra_study, acc, biosample, sample_acc, organism, assay_type, librarysource,
  libraryselection, librarylayout, library_name, platform, instrument, avgspotlen, mbases, mbytes,
  strftime(releasedate, '%Y-%m-%d %H:%M:%S.%f UTC') AS releasedate,
  lib_lc, libsel_lc, attr_blob, label_blob FROM runs"""
    ),
    "stage_audit": _over_runs(
        """SELECT count(DISTINCT anchors.bioproject) AS anchored_bioprojects,
  count(DISTINCT runs.bioproject) AS with_runs_pulled, count(acc) AS total_runs
FROM anchors LEFT JOIN runs USING (bioproject)"""
    ),
    "tissue_blob": _over_runs("SELECT acc, tissue_blob FROM runs"),
    "case_control_tag": _over_labelled("SELECT acc, ad_hit, ctrl_hit FROM labelled"),
    "first_term": _over_labelled("SELECT acc, ad_term, ctrl_term FROM labelled"),
    "single_cell_flags": _over_runs(
        f"""SELECT acc, {_CELL_WORDS} AS by_text,
  {_CELL_WORDS} OR {_CELL_SOURCE} AS by_source_or_text FROM runs"""
    ),
    "srna_evidence": _over_labelled("SELECT acc, srna_evidence FROM labelled"),
    "tissue_class": _over_labelled("SELECT acc, tissue_class FROM labelled"),
    "disjoint_arms": _over_labelled(
        f"SELECT {_KEYS}, {_figures(_ARMS)} FROM labelled GROUP BY ALL"
    ),
    "study_aggregate_small_rna": _with(
        *_UP_TO_RUNS, _LABELLED, _STUDIES, select="FROM studies"
    ),
    "evidence_kinds": _over_labelled(
        f"""SELECT {_KEYS}, count(srna_evidence) AS n_smallrna,
  {_figures({"n_tissue_relevant": "regexp_matches(tissue_class, '^(brain|csf$|biofluid$)')"})},
  {_cell("srna_evidence_kinds", "srna_evidence")} FROM labelled GROUP BY ALL"""
    ),
    "keep_small_rna": _kept_studies(),
    "keep_relaxed_1": _kept_studies(min_size=_NO_SIZE),
    "keep_relaxed_2": _kept_studies(min_size=_NO_SIZE, longest=150),
    "keep_relaxed_3": _kept_studies(min_size=_NO_SIZE, longest=150, attributes=True),
    "keep_relaxed_4": _kept_studies(
        min_size=_NO_SIZE, longest=150, attributes=True, arm=2
    ),
    "tissue_detail": _small_screen("FROM tissues"),
    "screen_small_rna": _small_screen(f"FROM report {_SMALL_RANK}"),
    "ladder_small_rna": _small_ladder(),
    "label_eff": _over_target("SELECT acc, label_eff FROM target_runs"),
    "priming_class": _over_target("SELECT acc, priming_class FROM target_runs"),
    "read_class": _over_target("SELECT acc, read_class FROM target_runs"),
    "rna_class": _over_target("SELECT acc, rna_class FROM target_runs"),
    "strain_control": _over_target(
        "SELECT acc, ad_hit, ctrl_hit, ad_term, ctrl_term FROM target_runs"
    ),
    "is_target": _over_target("SELECT acc, single_cell, is_target FROM target_runs"),
    "study_aggregate_target": _with(
        *_UP_TO_RUNS, _target_runs(), _TARGET_STUDIES, select="FROM studies"
    ),
    "tissue_detail_target": _with(
        *_UP_TO_RUNS,
        _target_runs(),
        _tissue_details("target_runs WHERE is_target"),
        select="FROM tissues",
    ),
    "screen_total_long": _target_screen(),
    "matched_design": _target_screen("least(n_small_rna, n_target_runs) > 0"),
    "target_relaxed_1": _target_screen(long_inferred=True),
    "target_relaxed_2": _target_screen(long_inferred=True, unspecified=True),
    "target_relaxed_3": _target_screen(
        long_inferred=True, unspecified=True, any_organism=True
    ),
    "ladder_total_long": _target_ladder(),
    "inspect_studies": _over_runs(
        """SELECT bioproject, sra_study, acc, biosample, assay_type, libraryselection,
  library_name, avgspotlen, round(mbytes::DOUBLE / 1024, 3) AS gb, label_blob, attr_blob
FROM runs WHERE bioproject IN ('PRJ3', 'PRJ10', 'PRJ39') ORDER BY bioproject, acc"""
    ),
    "list_screen": _target_screen(
        "bioproject IN (SELECT 'PRJ' || (doc_id % 45) FROM labels WHERE toxic = 1)"
    ),
    "accession_list": _over_runs("SELECT acc FROM runs WHERE bioproject = 'PRJ3'"),
    "preview": _with(
        _METADATA,
        select="""SELECT acc, organism, assay_type, mbases FROM metadata
WHERE organism = 'Homo sapiens' AND consent = 'public' ORDER BY acc LIMIT 10""",
    ),
    "array_cells": _over_labelled(
        f"""SELECT bioproject, {_cell("ad_terms", "ad_term")}, {_cell("ctrl_terms", "ctrl_term")},
  {_cell("assay_types", "assay_type")}, {_LATEST} FROM labelled GROUP BY ALL"""
    ),
    "normalise_records": _with(_RECORDS, select="FROM records"),
    "json_records": _with(
        _RECORDS,
        select=f"SELECT {', '.join(RAW_COLUMNS)} FROM raw WHERE seq // 5 % 7 <> 3",
    ),
    "unreadable_documents": _with(
        _RECORDS,
        select="SELECT DISTINCT (seq // 5)::BIGINT AS document_seq FROM raw WHERE seq // 5 % 7 = 3",
    ),
    "enrich": _with(
        *_UP_TO_RUNS,
        _RECORDS,
        f"sheet AS (SELECT {_KEYS}, count(*) AS n_runs FROM runs GROUP BY ALL)",
        select=f"""SELECT * EXCLUDE (told) FROM (SELECT {_KEYS}, n_runs, {_FILLED},
  lower(concat_ws(' ', study_title, study_description)) AS told,
  {_flag("title_mentions_alzheimer", v.TITLE_DISEASE_WORDS)},
  {_flag("title_mentions_mirna", v.TITLE_ASSAY_WORDS)}
FROM sheet LEFT JOIN records ON bioproject = project_acc)""",
    ),
    "missing_records": _with(
        *_UP_TO_RUNS,
        _RECORDS,
        select="""SELECT bioproject FROM runs
ANTI JOIN records ON bioproject = project_acc GROUP BY bioproject""",
    ),
    "sheet_round_trip": _with(
        _RECORDS,
        select="""SELECT coalesce(project_acc, '') AS bioproject, project_title, project_description,
  submitter_organization, coalesce(registration_date, '') AS registration_date, project_data_type,
  '[' || array_to_string(string_split(project_title, ' '), ',') || ']' AS title_words,
  seq::VARCHAR AS seq FROM raw""",
    ),
    "interval_round_trip": """SELECT 'site' || l_orderkey || '.' || l_linenumber AS GeneID,
  'chr' || (l_suppkey % 22 + 1) AS Chr, l_orderkey * 10 AS Start,
  l_orderkey * 10 + l_partkey AS "End",
  CASE l_linenumber % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' END AS Strand FROM lineitem""",
    "ascii_boundary_match": r"""SELECT doc_id, regexp_matches(text, '\bla\b') AS has_la,
  regexp_matches(text, '\bde\s\w') AS has_de,
  nullif(regexp_extract(text, '\b(?:el|le|un)\b'), '') AS article
FROM documents""",
}
