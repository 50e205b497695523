"""Postings made from the supplied tables by portable SQL: documents joined with suppliers, templates by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2026-07-20 12:00:00"


def _choose(expression: str, values: list[str], column: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(values))
    return f"CASE {expression} {cases} END AS {column}"


TITLES = ["Analista de Logística", "ASISTENTE DE PLANEAMIENTO", "Practicante de Ingeniería", "Analista Senior de Datos", "Analista Semi Senior", "Jefe de Almacén", "Auxiliar de Producción", "Operario de planta", "Coordinador de Compras", "Trainee Comercial", "Analista de Ventas"]
PLACES = ["San Isidro, Lima", "Huaral, Lima", "Arequipa, Arequipa", "", "Bellavista, Callao", "Lima, Lima Province, Peru", "Trujillo, La Libertad"]
DATES = ["2026-07-15", "2026-07-10T08:30:00", "05/07/2026", "hace 2 semanas", "", "2026-05-01 10:00:00", "ayer", "1784246400000"]
WANTED = [
    "Requisitos: Egresado de Ingeniería Industrial. Experiencia mínima de 1 año en puestos similares. Excel avanzado y SQL. Sueldo S/ 1,500 a S/ 2,000.",
    "Requisitos: Bachiller en Ingeniería Industrial o Administración. De 2 a 3 años de experiencia. Deseable manejo de Power BI y SAP.",
    "Perfil: Técnico en logística. Experiencia mínima de 6 meses. Beneficios: ingreso a planilla desde el primer día y EPS.",
    "Somos una empresa con 20 años de experiencia en el mercado. Sin experiencia previa. Modalidad remoto.",
    "Ingeniería Industrial, maestría deseable. 5 años de experiencia en supply chain. Inglés avanzado. Régimen 14x7 en campamento.",
    "Carrera de Ingeniería Industrial y/o afines. Experiencia comprobable. Control de inventarios, presupuesto y KPIs. Licencia de conducir.",
    "Ventas en campo. Salario US$ 900. Trabajo híbrido. Inglés intermedio. Bonos y capacitación.",
    "Ingeniero industrial titulado y colegiado. Experiencia no menor a 18 meses como analista de procesos. Python y dashboards.",
    "Seguridad industrial en planta. Secundaria completa. Camioneta 4x4.",
]
MODES, AREAS, PAY = ["Presencial", "Remoto", "Hibrido", ""], ["", "Logística y Distribución", "Marketing", "Legal"], ["No especificado", "S/ 1800 - 2500", ""]

OFFERS_SQL = f"""
SELECT d.doc_id, cast(1 + d.doc_id % 3 AS int) AS src_ord, cast(floor(d.doc_id / 50.0) AS int) AS page, cast(d.doc_id % 50 AS int) AS item,
  {_choose("d.doc_id % 3", ["portal_a", "portal_b", "portal_c"], "portal")},
  {_choose("d.doc_id % 11", TITLES, "puesto")},
  s.s_name AS empresa,
  {_choose("d.doc_id % 7", PLACES, "ubicacion")},
  concat('https://jobs.example.com/o/', cast(CASE WHEN d.doc_id % 10 = 9 THEN d.doc_id - 1 ELSE d.doc_id END AS varchar(20)), '/?ref=', cast(d.doc_id AS varchar(20))) AS url,
  {_choose("d.doc_id % 8", DATES, '"fechaPublicacion"')},
  {_choose("d.doc_id % 3", PAY, "salario")},
  {_choose("d.doc_id % 4", MODES, "modalidad")},
  {_choose("d.doc_id % 4", AREAS, "area")},
  concat({_choose("d.doc_id % 9", WANTED, "x")[:-5]}, ' ', d.text) AS descripcion
FROM documents d JOIN supplier s ON d.doc_id % (SELECT count(*) FROM supplier) = s.s_suppkey
"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of a data folder; suppliers are few and known by key, so Spark may broadcast them by their size."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    return spark.sql(OFFERS_SQL.replace('"fechaPublicacion"', "fechaPublicacion").replace("FROM documents", "FROM {documents}").replace("JOIN supplier", "JOIN {supplier}").replace("FROM supplier", "FROM {supplier}"), documents=documents, supplier=supplier)
