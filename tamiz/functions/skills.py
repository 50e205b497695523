"""Fixed values of the requirement extractor: categories, skills, patterns, section headings."""

#: category -> base relevance
CATEGORIES = {"BI_DATOS": 95, "PROGRAMACION": 95, "OFIMATICA": 90, "ERP_CRM": 85, "DISENO_TECNICO": 80, "METODOLOGIA": 70, "NORMATIVA": 70, "IDIOMA": 65, "FUNCIONAL": 50, "FORMACION": 35, "BLANDA": 20}

#: category -> lines "name = pattern"; a name may be followed by [level] (has levels), [parent X], [relevance N].
SKILLS = {
    "OFIMATICA": r"""
Excel [level] = \bexcel\b
Word [level] = \bword\b
PowerPoint [level] = \bpower\s*point\b|\bppt\b
Outlook = \boutlook\b
Google Sheets = \bgoogle\s+sheets\b|\bhojas?\s+de\s+calculo\b
Office [level] = \b(microsoft|ms)\s+office\b|\boffice\s*365\b|\bofimatica\b|\bpaquete\s+office\b
""",
    "BI_DATOS": r"""
Power BI [level] = \bpower\s*bi\b
Tableau [level] = \btableau\b
Looker / Data Studio = \blooker\b|\bdata\s+studio\b
Power Query [level] = \bpower\s*query\b
Power Pivot = \bpower\s*pivot\b
DAX = \bdax\b
Power Apps / Automate = \bpower\s*(apps|automate)\b
Tablas dinámicas [relevance 60] = \btablas\s+dinamicas\b
Dashboards [relevance 60] = \bdashboards?\b|\btableros?\s+de\s+control\b
ETL = \betl\b|\bpipelines?\s+de\s+datos\b
Databricks = \bdatabricks\b
Big Data [relevance 60] = \bbig\s+data\b|\bmineria\s+de\s+datos\b
""",
    "PROGRAMACION": r"""
SQL [level] = \bsql\b
MySQL [parent SQL] = \bmy\s*sql\b
PostgreSQL [parent SQL] = \bpostgre\s*sql\b
SQL Server [parent SQL] = \bsql\s+server\b
BigQuery [parent SQL] = \bbig\s*query\b
Python [level] = \bpython\b|\bphyton\b|\bpyton\b
R = \br\s*studio\b|\blenguaje\s+r\b
VBA / Macros = \bvba\b|\bmacros?\b
Java = \bjava\b(?!script)
JavaScript = \bjavascript\b
.NET / C# = \.net\b|\bc#
Git = \bgit(hub|lab)?\b
Linux = \blinux\b
Cloud (AWS/Azure/GCP) = \baws\b|\bazure\b|\bgoogle\s+cloud\b|\bgcp\b
""",
    "ERP_CRM": r"""
SAP [level] = \bsap\b
SAP MM [parent SAP] = \bsap\s+mm\b
SAP PP [parent SAP] = \bsap\s+pp\b
SAP FI [parent SAP] = \bsap\s+fi\b
SAP CO [parent SAP] = \bsap\s+co\b
SAP SD [parent SAP] = \bsap\s+sd\b
SAP WM [parent SAP] = \bsap\s+wm\b
SAP HCM [parent SAP] = \bsap\s+hcm\b
SAP BW [parent SAP] = \bsap\s+bw\b
Oracle = \boracle\b
JD Edwards = \bjd\s+edwards\b
Dynamics = \bdynamics\b
Odoo = \bodoo\b
ERP contable local = \b(concar|starsoft|siscont|contasis|softland)\b
ERP [relevance 75] = \berp\b
CRM = \bcrm\b
Salesforce [parent CRM] = \bsalesforce\b
HubSpot [parent CRM] = \bhubspot\b
""",
    "METODOLOGIA": r"""
Lean = \blean\b
Six Sigma = \bsix\s+sigma\b
Kaizen = \bkaizen\b
5S = \b5\s*'?s\b
Scrum = \bscrum\b
Agile = \bagile\b|\bagiles?\b|\bmetodologias?\s+agil
Kanban = \bkanban\b
Jira = \bjira\b
BPM / BPMN = \bbpmn\b|\bbusiness\s+process\b|\bbpm\b(?!\s*y?\s*poes)
PMP / PMI = \bpmp\b|\bpmi\b|\bpmbok\b
MS Project = \b(ms|microsoft)\s+project\b
Design Thinking = \bdesign\s+thinking\b
Mejora continua [relevance 55] = \bmejora\s+continua\b
""",
    "NORMATIVA": r"""
ISO 9001 = \biso\s*9001\b
ISO 14001 = \biso\s*14001\b
ISO 45001 = \biso\s*45001\b
ISO 27001 = \biso\s*27001\b
ISO 17025 = \biso\s*17025\b
ISO 22000 = \biso\s*22000\b
SSOMA = \bssoma\b
Seguridad y Salud (SST) = \bseguridad\s+y\s+salud\b|\bsst\b|\bley\s*29783\b
HACCP / BPM-POES = \bhaccp\b|\bpoes\b
NIIF / IFRS = \bniif\b|\bifrs\b
SBS = \bsbs\b
LA/FT = \bla\s*/\s*ft\b|\blavado\s+de\s+activos\b
SUNAT / Tributario = \bsunat\b|\btributari[oa]\b
""",
    "DISENO_TECNICO": r"""
AutoCAD [level] = \bauto\s*cad\b
SolidWorks = \bsolid\s*works\b
Revit = \brevit\b
SketchUp = \bsketch\s*up\b
Bizagi [level] = \bbizagi\b
Visio [level] = \bvisio\b
Lucidchart / Miro = \blucidchart\b|\bmiro\b
ArcGIS / QGIS = \barc\s*gis\b|\bqgis\b
""",
    "IDIOMA": r"""
Inglés [level] = \bingles\b|\benglish\b
Portugués [level] = \bportugues\b
Quechua = \bquechua\b
""",
    "FUNCIONAL": r"""
KPIs [relevance 60] = \bkpis?\b|\bindicadores\s+de\s+gestion\b
Logística / Supply Chain = \blogistica\b|\bsupply\s+chain\b|\bcadena\s+de\s+suministro\b|\babastecimiento\b
Comercio exterior = \bcomercio\s+exterior\b|\baduan\w*|\bimportacion\w*|\bexportacion\w*|\bincoterms?\b
Inventarios = \binventari\w*|\bkardex\b
Costos = \bcostos\b|\bcosteo\b
Presupuestos = \bpresupuest\w*
Facturación = \bfacturacion\b
Conciliaciones = \bconciliaci\w*
Cobranzas = \bcobranza\w*|\bmorosidad\b|\brecuperacion\s+de\s+cartera\b
Créditos / Evaluación crediticia = \bevaluacion\s+crediticia\b|\banalisis\s+de\s+creditos?\b|\bcolocacion\w*\s+de\s+creditos?\b|\bcreditos?\s+mype\b
Planillas / Nómina = \bplanillas?\b|\bnomina\b|\bpdt\b|\bplame\b
Reclutamiento = \breclutamiento\b|\bseleccion\s+de\s+personal\b
Atención al cliente = \batencion\s+al\s+cliente\b|\bservicio\s+al\s+cliente\b|\bpost\s*venta\b
Ventas / Negociación = \bnegociacion\b|\bcierre\s+de\s+ventas\b|\bprospeccion\b
Marketing digital = \bseo\b|\bsem\b|\bgoogle\s+ads\b|\bmeta\s+ads\b|\bga4\b|\bmarketing\s+digital\b
Gestión de riesgos = \bgestion\s+de\s+riesgos?\b|\briesgo\s+operacional\b|\bmatriz\s+de\s+riesgos?\b
Auditoría = \bauditoria\b|\bcontrol\s+interno\b
Control de gestión = \bcontrol\s+de\s+gestion\b|\bplaneamiento\s+financiero\b|\bfp&a\b
Compras / Procura = \bcompras\b|\bprocura\w*|\bhomologacion\s+de\s+proveedores\b|\bcotizacion\w*
""",
    "FORMACION": r"""
Bachiller / Titulado = \bbachiller\b|\btitulad[oa]\b|\begresad[oa]\b|\btitulo\s+profesional\b
Estudios universitarios = \buniversitari[oa]\b|\bestudios\s+universitarios\b
Técnico = \btecnic[oa]\s+(superior|complet[oa]|titulad[oa])\b|\binstituto\s+tecnico\b
Maestría / MBA / Diplomado = \bmaestria\b|\bmba\b|\bdiplomado\b|\bespecializacion\b|\bpostgrado\b
Colegiatura = \bcolegiatura\b|\bcolegiad[oa]\b
Licencia de conducir = \blicencia\s+de\s+conducir\b|\bbrevete\b
Disponibilidad para viajar = \bdisponibilidad\s+(para|de)\s+viajar\b|\bviajes\s+a\s+provincia\b
Residir en zona = \bresidir\s+en\b|\bvivir\s+cerca\b
""",
    "BLANDA": r"""
Trabajo en equipo = \btrabajo\s+en\s+equipo\b
Liderazgo = \bliderazgo\b|\bmanejo\s+de\s+equipos?\b
Comunicación efectiva = \bcomunicacion\s+(efectiva|asertiva|clara)\b
Orientación a resultados = \borientacion\s+a\s+(resultados|logros)\b
Pensamiento analítico = \b(pensamiento|capacidad|perfil)\s+analitic\w*
Proactividad = \bproactiv\w*
""",
}

ENTITIES = {
    "&amp;": "&", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&ntilde;": "ñ", "&aacute;": "á", "&eacute;": "é", "&iacute;": "í",
    "&oacute;": "ó", "&uacute;": "ú", "&uuml;": "ü", "&hellip;": "...", "&mdash;": "-", "&ndash;": "-",
}
GLUED = r"([a-z0-9áéíóúñ])([A-ZÁÉÍÓÚÑ])"

EXCLUDED_HEADING = r"beneficios|te\s+ofrecemos|que\s+ofrecemos|ofrecemos|condiciones\s+laborales|condiciones|postulacion|como\s+postular"
REQUIRED_HEADING = r"requisitos|perfil|conocimientos|competencias|que\s+buscamos|buscamos|formacion|estudios|requerimientos|indispensable|deseable|habilidades"
DUTIES_HEADING = r"funciones|responsabilidades|retos|que\s+haras|mision\s+del\s+puesto|principales\s+actividades|desafios"
HEADING_TAIL = r"\b[^\n:.]{0,32}:"

LEVELS = (
    ("BASICO", r"\bbasic|\busuario\b|\bnivel\s+inicial\b|\ba1\b|\ba2\b"),
    ("INTERMEDIO", r"\bintermedi|\bb1\b|\bb2\b"),
    ("AVANZADO", r"\bavanzad|\bexpert|\bdominio\s+total\b|\bc1\b|\bc2\b"),
)
DESIRABLE = r"\bdeseable\b|\bno\s+excluyente\b|\bopcional\b|\bde\s+preferencia\b|\bpreferentemente\b|\bplus\b|\bvalorad\w*|\bnice\s+to\s+have\b|\bno\s+indispensable\b"
MANDATORY = r"\bindispensable\b|\bexcluyente\b|\bobligatori\w*|\bimprescindible\b|\brequisito\s+minimo\b"
CONNECTOR = r"[\s,/y o\-–()]*"
CONFIDENCE = {"ALTA": 20, "MEDIA": 8, "BAJA": 0}
CHARS_AFTER, CHARS_BEFORE = 60, 45
