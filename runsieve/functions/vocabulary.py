"""Default vocabularies of the screens, written in RE2 syntax.

Every operator takes a :class:`Vocabulary`; replace single fields with
``dataclasses.replace`` to screen for another disease or assay.
"""

from __future__ import annotations

from dataclasses import dataclass

# Results depend on these texts letter by letter.
LABEL_KEYS = r"disease|diagnos|phenotype|condition|group|genotype|strain|status|cohort|treatment|braak|cerad|subject|clinical|histolog|neuropath|description|title"
TISSUE_KEYS = r"tissue|source_?name|organ|body_?site|biomaterial|cell_?type|cell_?line|isolate|sample_?type|anatom|region|brain"
DIET_PHRASE = r"ad libitum"
NEGATED_TERMS = r"alzheimer[a-z\']*|demented|dementia|tg|transgenic|carrier|ad"
NEGATION_TOKEN = " negctrl "
CASE_TERMS = r"alzheimer|\bdementia\b|\bbraak\b|\bcerad\b|nia[-_ ]?reagan|neurofibrillary|senile plaque|amyloid|tauopath|\bptau\b|app[-_/ ]?ps1|appswe|ps1de9|psen1de9|5x[-_ ]?fad|e4fad|3x[-_ ]?tg|tg2576|tgcrnd8|\bj20\b|r?tg4510|p301[sl]|\bps19\b|\bhtau\b|thy[-_ ]?tau22|tastpm|nl[-_ ]?g[-_ ]?f|samp8"
CONTROL_TERMS = r"negctrl|\bcontrol\b|\bctrl\b|\bhealthy\b|\bnormal\b|unaffected|non[-_ ]?demented|\bnd\b|wild[-_ ]?type|\bwt\b|\bntg\b|\bnon[-_ ]?tg\b|littermate|cognitively (?:normal|intact)|\bcn\b"
STRAIN_TERMS = r"c57bl|c57black|\bb6129|129s[0-9]?[/ ]|balb[-_/ ]?c|\bfvb\b|\bicr\b|swiss webster"
SMALL_RNA_TERMS = r"mirna|micro[-_ ]?rna|small[-_ ]?rna|\bsrna\b|\bsmrna\b|size fractionation|small ncrna"
SINGLE_CELL_TERMS = r"single[-_ ]?cell|single[-_ ]?nucle|10x genomics|chromium|smart[-_ ]?seq|drop[-_ ]?seq|cel[-_ ]?seq|scrna|snrna[-_ ]?seq|10xv[23]|plate[-_ ]?based"
DEPLETION_TERMS = r"random[-_ ]?(?:hexamer|primer|priming)|ribo[-_ ]?zero|ribozero|ribo[-_ ]?erase|riboerase|ribo[-_ ]?minus|rrna[-_ ]?deplet|rrna[-_ ]?remov|depletion of (?:cytoplasmic )?rrna|ribosomal rna deplet|inverse rrna|whole[-_ ]?transcriptome|total[-_ ]?rna[-_ ]?seq|smarter[-_ ]?stranded|truseq stranded total"
POLYA_TERMS = r"poly[-_ ]?a[-_ ]?(?:select|enrich|captur|plus)|polyadenylat|oligo[-_ ]?dt|mrna captur|truseq (?:stranded )?mrna|nebnext.{0,20}poly"
LONG_READ_TERMS = r"sequel|revio|pacbio|\bsmrt\b|minion|gridion|promethion|nanopore|iso[-_ ]?seq|isoseq|direct[-_ ]?rna[-_ ]?seq|full[-_ ]?length (?:cdna|transcript)|long[-_ ]?read"
TISSUE_CLASSES = (
    ("brain_prefrontal", r"prefrontal|pre[-_ ]?frontal|\bpfc\b|\bdlpfc\b|brodmann|\bba\s?[0-9]|frontal"),
    ("brain_hippocampal", r"hippocamp|entorhinal|dentate|subiculum|\bca1\b|\bca3\b"),
    ("brain_other", r"temporal|parietal|occipital|cingulate|insula|cortex|cortical|amygdala|cerebell|striat|substantia|thalam|hypothalam|\bbrain\b|cerebr"),
    ("csf", r"\bcsf\b|cerebrospinal"),
    ("biofluid", r"plasma|\bserum\b|whole blood|\bblood\b|exosom|extracellular vesicle|\bevs?\b|urine|saliva|platelet"),
    ("cell_model", r"ipsc|hipsc|\bsh[-_ ]?sy5y\b|\bhek\b|\bn2a\b|neuro[-_ ]?2a|cell line|primary (?:culture|neuron)|organoid|\bnpc\b"),
)
ORGANISMS = ("Homo sapiens", "Mus musculus")
SMALL_RNA_ASSAYS = ("mirna-seq", "ncrna-seq")
GENERAL_RNA_ASSAYS = ("rna-seq", "other")
RANDOM_SELECTIONS = ("random", "random pcr", "cdna_randompriming")
DEPLETION_SELECTION_PREFIX = "inverse rrna"
POLYA_SELECTIONS = ("polya", "oligo-dt", "cdna_oligo_dt")
OPEN_SELECTIONS = ("cdna", "unspecified", "other", "")
LONG_READ_PLATFORMS = ("PACBIO_SMRT", "OXFORD_NANOPORE")
SINGLE_CELL_SOURCE = "transcriptomic single cell"
RNA_SOURCE_PREFIX = "transcriptomic"
BULK_RNA_SOURCE = "TRANSCRIPTOMIC"
BULK_RNA_ASSAY = "RNA-Seq"
INFERRED_SMALL_RNA_LENGTH = (15, 51)
INFERRED_LONG_READ_FROM = 600
TITLE_DISEASE_WORDS = ("alzheimer", "dementia", "amyloid", "tauopath", "neurodegener")
TITLE_ASSAY_WORDS = ("mirna", "microrna", "micro-rna", "small rna", "smallrna", "ncrna")
# End of the fixed values.


@dataclass(frozen=True)
class Vocabulary:
    """Patterns, value lists and lengths used by the run classifiers."""

    label_keys: str = LABEL_KEYS
    tissue_keys: str = TISSUE_KEYS
    blanked_phrase: str = DIET_PHRASE
    negated_terms: str = NEGATED_TERMS
    negation_token: str = NEGATION_TOKEN
    case_terms: str = CASE_TERMS
    control_terms: str = CONTROL_TERMS
    strain_terms: str = STRAIN_TERMS
    small_rna_terms: str = SMALL_RNA_TERMS
    single_cell_terms: str = SINGLE_CELL_TERMS
    depletion_terms: str = DEPLETION_TERMS
    polya_terms: str = POLYA_TERMS
    long_read_terms: str = LONG_READ_TERMS
    tissue_classes: tuple[tuple[str, str], ...] = TISSUE_CLASSES
    small_rna_assays: tuple[str, ...] = SMALL_RNA_ASSAYS
    general_rna_assays: tuple[str, ...] = GENERAL_RNA_ASSAYS
    random_selections: tuple[str, ...] = RANDOM_SELECTIONS
    depletion_selection_prefix: str = DEPLETION_SELECTION_PREFIX
    polya_selections: tuple[str, ...] = POLYA_SELECTIONS
    open_selections: tuple[str, ...] = OPEN_SELECTIONS
    long_read_platforms: tuple[str, ...] = LONG_READ_PLATFORMS
    single_cell_source: str = SINGLE_CELL_SOURCE
    rna_source_prefix: str = RNA_SOURCE_PREFIX
    bulk_rna_source: str = BULK_RNA_SOURCE
    bulk_rna_assay: str = BULK_RNA_ASSAY
    #: Mean read lengths that count as small RNA, where nothing else is declared.
    inferred_length: tuple[int, int] = INFERRED_SMALL_RNA_LENGTH
    #: Mean read length from which on a run counts as long read.
    long_read_from: int = INFERRED_LONG_READ_FROM


DEFAULT = Vocabulary()
