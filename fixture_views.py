"""Views over the generated test tables, in the shape the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Run metadata derived from ``orders``; Spark and DuckDB run it unchanged. Study
#: PRJ9999 holds a third of all runs.
RUN_VIEW = """
SELECT
  'SRR' || o_orderkey AS acc,
  'PRJ' || CASE o_orderkey % 3 WHEN 0 THEN 9999 WHEN 1 THEN o_custkey % 40 ELSE o_custkey END AS bioproject,
  CASE WHEN o_custkey % 40 = 39 THEN NULL
       ELSE 'SRP' || CASE o_orderkey % 3 WHEN 0 THEN 9999 WHEN 1 THEN o_custkey % 40 ELSE o_custkey END END AS sra_study,
  'SAM' || (o_orderkey - o_orderkey % 2) AS biosample,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'SRS' || o_orderkey END AS sample_acc,
  CASE WHEN o_orderkey % 2 = 0 THEN 'PAIRED' ELSE 'SINGLE' END AS librarylayout,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS mbases,
  CASE WHEN o_custkey % 40 IN (13, 39) AND o_orderkey % 2 = 0 THEN 'Homo sapiens'
       WHEN o_custkey % 8 = 7 THEN 'Rattus norvegicus'
       WHEN o_custkey % 2 = 0 THEN 'Homo sapiens'
       ELSE 'Mus musculus' END AS organism,
  CASE WHEN o_orderkey % 17 = 0 THEN 'controlled' ELSE 'public' END AS consent,
  CASE o_custkey % 4 WHEN 0 THEN 'miRNA-Seq' WHEN 1 THEN 'RNA-Seq'
                     WHEN 2 THEN 'OTHER' ELSE NULL END AS assay_type,
  CASE o_custkey % 5 WHEN 1 THEN 'TRANSCRIPTOMIC SINGLE CELL' WHEN 2 THEN 'GENOMIC'
                     WHEN 3 THEN NULL ELSE 'TRANSCRIPTOMIC' END AS librarysource,
  CASE WHEN o_custkey % 40 IN (4, 9, 21) THEN
         CASE o_orderkey % 4 WHEN 0 THEN 'Inverse rRNA' WHEN 1 THEN 'cDNA' ELSE NULL END
       WHEN o_custkey % 40 IN (17, 22, 26, 29) THEN NULL
       ELSE
       CASE o_orderkey % 7 WHEN 0 THEN 'RANDOM' WHEN 1 THEN 'Inverse rRNA' WHEN 2 THEN 'PolyA'
                      WHEN 3 THEN 'size fractionation' WHEN 4 THEN 'cDNA'
                      WHEN 5 THEN NULL ELSE 'PCR' END END AS libraryselection,
  CASE WHEN o_custkey % 40 = 10 THEN 'smart-seq plate'
       WHEN o_orderkey % 6 = 0 THEN 'WT-107'
       WHEN o_orderkey % 6 = 1 THEN 'AD3.R1'
       WHEN o_custkey % 40 = 17 THEN 'plain'
       WHEN o_orderkey % 6 = 2 THEN 'ribo-zero prep'
       WHEN o_orderkey % 6 = 3 THEN NULL
       WHEN o_orderkey % 6 = 4 THEN 'oligo-dT prep' ELSE 'lib' END AS library_name,
  CASE o_orderkey % 9 WHEN 0 THEN 'PACBIO_SMRT' WHEN 1 THEN NULL ELSE 'ILLUMINA' END AS platform,
  CASE o_orderkey % 9 WHEN 0 THEN 'Sequel II' WHEN 2 THEN 'MinION' ELSE 'NovaSeq' END AS instrument,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL
       WHEN o_custkey % 40 IN (8, 18) THEN 125 + o_orderkey % 20
       WHEN (o_custkey % 40) % 3 = 0 OR o_custkey % 40 IN (22, 26) THEN 15 + o_orderkey % 100
       ELSE o_orderkey % 900 END AS avgspotlen,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL
       WHEN o_custkey % 40 IN (12, 24) THEN o_orderkey % 12
       ELSE CAST(floor(o_totalprice / 100) AS BIGINT) END AS mbytes,
  o_orderdate AS releasedate,
  CASE WHEN o_custkey % 40 IN (5, 15, 25, 35) THEN 'not recorded'
       ELSE CASE o_orderkey % 10 WHEN 0 THEN 'Alzheimer''s disease' WHEN 1 THEN 'non-demented'
            WHEN 2 THEN 'healthy control' WHEN 3 THEN 'dementia, control arm'
            WHEN 4 THEN NULL ELSE 'na' END END AS a_disease,
  CASE WHEN o_custkey % 40 IN (5, 15, 25, 35) THEN 'C57BL/6J'
       ELSE CASE o_orderkey % 8 WHEN 0 THEN '5xFAD on C57BL/6J' WHEN 1 THEN 'C57BL/6J'
            WHEN 2 THEN 'APP/PS1' WHEN 3 THEN 'wild type'
            ELSE o_orderpriority END END AS a_strain,
  CASE WHEN o_custkey % 40 IN (2, 16) THEN CASE o_orderkey % 2 WHEN 0 THEN 'CSF' ELSE 'plasma' END
       WHEN o_custkey % 40 IN (6, 20) THEN 'hippocampus'
       WHEN o_custkey % 40 IN (28, 32) THEN NULL
       ELSE
       CASE o_orderkey % 11 WHEN 0 THEN 'prefrontal cortex' WHEN 1 THEN 'hippocampus'
       WHEN 2 THEN 'cerebellum' WHEN 3 THEN 'CSF' WHEN 4 THEN 'plasma' WHEN 5 THEN 'iPSC'
       WHEN 6 THEN 'liver' ELSE NULL END END AS a_tissue,
  CASE WHEN o_custkey % 40 IN (22, 26) AND o_orderkey % 4 < 2 THEN 'small rna isolation kit'
       ELSE 'fetal bovine serum, ad libitum' END AS a_media
FROM orders
"""

#: A projection with a function of higher order stays out of whole-stage code, so
#: that its columns are made in methods of their own. In one method the view exceeds the
#: 8,000 bytes of code that the JVM compiles, and every run is then made interpreted.
_NESTED = """
SELECT bioproject, sra_study, acc, biosample, sample_acc,
  organism, assay_type, librarysource, libraryselection,
  librarylayout, library_name, platform, instrument,
  avgspotlen, mbases, mbytes, releasedate, consent,
  zip_with(
    array('disease_state', 'strain', 'tissue', 'growth_media'),
    array(a_disease, a_strain, a_tissue, a_media),
    (k, v) -> struct(k AS k, v AS v)
  ) AS attributes
"""

#: Records of documents over even accessions only; some titles hold flag words.
RECORD_VIEW = """
SELECT 'PRJ' || (2 * (doc_id % 300)) AS project_acc,
       '  Study ' || doc_id || CASE doc_id % 4 WHEN 0 THEN ' of Alzheimer disease '
         WHEN 1 THEN ' microRNA ' ELSE ' ' END || source || ' ' AS project_title,
       text AS project_description,
       source AS submitter_organization,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '2020/01/0' || (doc_id % 9 + 1) END AS registration_date,
       lang AS project_data_type,
       doc_id AS seq
FROM documents
"""

RAW_COLUMNS = (
    "project_acc",
    "project_title",
    "project_description",
    "submitter_organization",
    "registration_date",
    "project_data_type",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    flat = RUN_VIEW.replace("FROM orders", "FROM {orders}")
    return spark.sql(f"{_NESTED} FROM ({flat})", orders=orders)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def study_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = RECORD_VIEW.replace("FROM documents", "FROM {documents}")
    return spark.sql(view, documents=documents(spark, sf_dir))
