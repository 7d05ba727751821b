"""What a record is about: reasoning concepts in several languages, measurement roles, identifiers, numbers, language.

Concepts and roles are small fixed tables that become expressions; all of it is JVM-side.  Texts are word forms
(functions.text.word_form) where a docstring says form.  Null gives null or an empty array.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of each concept.
CONCEPTS = {
    "protocol_deviation": ["protocol deviation", "conduct departure", "departed from plan", "方案偏离", "偏离方案", "desviación del protocolo", "プロトコル逸脱"],
    "investigational_intervention": ["investigational", "experimental", "研究性", "试验性", "en investigación", "治験中", "実験的", "시험용", "연구용", "시험 약물", "시험용 시냅스 조절제"],
    "rescue_intervention": ["rescue dose", "rescue intervention", "补救用药", "补救措施", "dosis de rescate", "intervención de rescate", "レスキュー投与", "救済介入", "구조용", "구조 약물", "구조용 스테로이드", "구조 스테로이드"],
    "unverified_source": ["unverified", "not verified", "未经核实", "尚未核实", "no verificado", "sin verificar", "未確認", "検証されていない", "확인되지 않았", "확인되지 않", "미확인"],
    "missing_evidence": ["missing", "absent", "unavailable", "cannot be inspected", "缺失", "不可用", "无法核查", "faltante", "no disponible", "ausente", "欠落", "利用できない", "자료가 없", "기록이 없", "누락", "없음"],
    "audit_or_adjudication": ["audit", "adjudication", "审计", "裁定", "auditoría", "adjudicación", "監査", "判定", "안전 위원회", "위원회 검토", "판정"],
    "hypothesis_only": ["hypothesis-level", "hypothesis generating", "supports a hypothesis", "只能形成假设", "假设层面", "nivel de hipótesis", "genera una hipótesis", "仮説レベル", "仮説生成"],
    "efficacy_claim": ["efficacy", "clinically effective", "patient benefit", "临床疗效", "治疗效果", "eficacia", "beneficio clínico", "有効性", "臨床的利益"],
    "causal_attribution": ["causal", "causally", "attribution", "因果", "归因", "atribución", "帰属", "인과", "인과성", "원인을 단정", "약물 탓"],
    "treatment_recommendation": ["treatment recommendation", "recommendation is requested", "治疗建议", "用药建议", "recomendación terapéutica", "治療推奨", "용량 권고", "치료 권고"],
    "biomarker_change": ["biomarker", "marker change", "phospho-marker", "标志物", "磷酸化", "biomarcador", "marcador fosforilado", "バイオマーカー", "リン酸化マーカー"],
    "renal_clearance": ["renal clearance", "clearance estimate", "renal exposure", "肾清除", "清除率", "肾暴露", "aclaramiento renal", "exposición renal", "腎クリアランス", "腎曝露"],
    "hydration_confounder": ["hydration", "fluid intervention", "补液", "水化", "hidratación", "intervención de líquidos", "補液", "水分介入"],
    "confounding": ["confounder", "confounding", "混杂", "factor de confusión", "confusión", "交絡", "交絡因子", "교란", "영향을 분리"],
    "uncertainty": ["uncertain", "uncertainty", "provisional", "不确定", "暂缓", "incierto", "incertidumbre", "不確実", "暫定", "확정되지 않", "불확실", "보류"],
}
#: Two of these three tell that a Korean text carries the boundary of a protected case.
BOUNDARY = ["missing_evidence", "causal_attribution", "uncertainty"]
#: Patterns of measured quantities.
ROLES = {
    "hepatic_enzyme": r"(?i)\balt\b|\b(?:alanine\s+)?aminotransferase\b|간\s*효소",
    "glucose": r"(?i)\bglucose\b|\bblood\s+sugar\b|혈당",
    "neurophysiology": r"(?i)\beeg\b|electroencephal|burst[- ]suppression|뇌파|신경생리|버스트\s*억제",
}
#: Words that tell Spanish.
SPANISH = ["desviación", "protocolo", "rescate", "evidencia", "eficacia", "causal", "auditoría", "adjudicación", "hidratación", "aclaramiento", "incertidumbre"]
#: A hyphenated code.
IDENTIFIER = r"(?<![\p{L}\p{N}_])[a-z][a-z0-9]{1,20}-[a-z0-9]{1,20}(?![\p{L}\p{N}_])"


def _form(phrase: str) -> str:
    return " ".join(re.sub(r"[^\w]+", " ", unicodedata.normalize("NFKC", phrase).casefold()).split())


def concepts(form: Column) -> Column:
    """Names of the concepts of which a form holds a phrase."""
    holds = lambda phrases: [F.contains(form, F.lit(_form(p))) for p in phrases]
    return F.array_compact(F.array(*[F.when(F.array_contains(F.array(*holds(phrases)), True), F.lit(name)) for name, phrases in CONCEPTS.items()]))


def roles(text: Column) -> Column:
    """Names of the quantities that a text of measured values mentions."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in ROLES.items()]))


def identifiers(text: Column) -> Column:
    """Distinct hyphenated codes in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(IDENTIFIER), F.lit(0)))


def numbers(form: Column) -> Column:
    """Distinct words of a form that are digits only; a decimal point parts the form's words."""
    return F.array_distinct(F.filter(F.split(form, " "), lambda x: x.rlike(r"^\p{Nd}+$")))


def language(text: Column) -> Column:
    """ko, ja, zh by script, in this order; es with two of its words as parts of the text; en else."""
    marks = sum((F.contains(text, F.lit(_form(w))).cast("int") for w in SPANISH), F.lit(0))
    by_script = F.when(text.rlike(r"[\x{ac00}-\x{d7af}]"), "ko").when(text.rlike(r"[\x{3040}-\x{30ff}]"), "ja").when(text.rlike(r"[\x{3400}-\x{9fff}]"), "zh")
    return by_script.when(marks >= 2, "es").when(text.isNotNull(), "en")
