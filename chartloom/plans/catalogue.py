"""Plans over in-memory fixtures: they show the document paths end to end and have no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions import confidence
from chartloom.plans import documents, pages, segments

#: A hand-written stool report of an invented person.
STOOL = """IP Patient : 53
Patient : JANE DOE
Né(e) le : 01/02/1980 - 40 ans
Sexe : F
Origine : Externe
Prescripteur : Dr. X
Date Demande : 03/06/2024 10:15
Date Réception : 03/06/2024 11:00
N° d'échantillon : 123456789
Nature : SELLES
LABORATOIRE CENTRAL
Laboratoire de Parasitologie Mycologie
Centre Hospitalo-Universitaire Mohammed VI - Oujda
EXAMEN PARASITOLOGIQUE DES SELLES
ECHANTILLON BIOLOGIQUE
NATURE DE PRÉLÈVEMENT : SELLES N°1
EXAMEN MACROSCOPIQUE
Couleur
: Marron
Consistance
: Molle
Glaire
: Présence
EXAMEN MICROSCOPIQUE
Leucocytes
: Assez nombreux
Hématies
: Absence
EXAMEN APRÈS ENRICHISSEMENT
: Négatif
EXAMEN APRÈS COLORATION
: Présence d'oeufs d'Ankylostoma duodenale
RÉSULTAT FINAL
: TRICHURIS TRICHIURA
Le : 04/06/2024 12:04:25
Edité(e) par : A B"""

#: A hand-written hospital report with numbers, units and reference ranges.
HOSPITAL = """LABORATOIRE CENTRAL
IP Patient : 77
Patient : JOHN ROE
Date Demande : 05/06/2024 08:00
N° d'échantillon : 987654321
PARAMETRES
Glycémie à jeun
5,4
mmol/L
4,1 - 6,1
Créatinine
9,8
mg/l
( 7 - 13 )
Cholestérol total
< 2,0 g/L
1,8g/L
Page 1 sur 1
Tel : 0536"""


def fixture(spark: SparkSession) -> DataFrame:
    rows = [("stool", 1, STOOL, STOOL), ("hospital", 1, HOSPITAL, HOSPITAL), ("note", 1, "Service d'imagerie\nRien à signaler", None)]
    return spark.createDataFrame(rows, "doc_id string, page_number int, final_text string, native_text string")


def stool_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents.head.document_lines(fixture(spark)).where("doc_id = 'stool'").select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_number", "p.lines", F.lit("native").alias("text_source"))
    return segments.finished(segments.stool_blocks(lines))


def ocr_row_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [("d", 1, 1, 1, 1, "world", 90.0, 50.0, 10.0, 90.0, 22.0), ("d", 1, 1, 1, 1, "hello", 80.0, 10.0, 11.0, 45.0, 20.0), ("d", 1, 1, 1, 2, "again", 70.0, 10.0, 30.0, 60.0, 41.0), ("d", 1, 1, 1, 2, "noise", -1.0, 70.0, 30.0, 80.0, 41.0)]
    frame = spark.createDataFrame(words, "doc_id string, page_number int, block_num int, par_num int, line_num int, text string, conf double, x0 double, y0 double, x1 double, y1 double")
    return pages.ocr_lines(frame)


def confidence_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents' first words with the seeded draw, which SQL has no function for."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return docs.select("doc_id", confidence.extraction_confidence(F.col("text"), F.lit("native")).alias("score"))


def queries():
    return {f.__name__: f for f in (confidence_jitter,)}
