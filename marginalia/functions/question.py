"""Question understanding: intents, alias families, scope, routing. Columns in, columns out."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import first_standard, squeeze

# Alias families of the domain, markers and scope terms.
FAMILIES: dict[str, tuple[str, ...]] = {
    "damping_ratio": ("damping ratio", "zeta", "ζ", "阻尼比", "相对阻尼"),
    "natural_frequency": ("natural frequency", "omega_n", "ωn", "固有频率", "自然频率"),
    "critical_speed": ("critical speed", "resonant speed", "resonance", "临界转速", "临界速度", "共振转速", "共振"),
    "rotor_unbalance": ("rotor unbalance", "unbalance", "不平衡", "转子不平衡"),
    "orbit": ("orbit", "shaft orbit", "轴心轨迹", "转子轨迹"),
    "synchronous_response": ("synchronous response", "1x", "一倍频", "同步响应"),
    "misalignment": ("misalignment", "不对中", "轴系不对中"),
    "bearing_fault": ("bearing fault", "bearing defect", "轴承故障"),
    "steam_turbine": ("steam turbine", "汽轮机", "汽轮", "透平"),
    "torsional_vibration": ("torsional vibration", "扭转振动", "扭振"),
    "order_analysis": ("order analysis", "order tracking", "阶比分析", "阶次分析"),
    "shaft_train": ("shaft train", "shafting", "轴系"),
    "angular_sampling": ("angular-domain", "angular-domain sampling", "equal-angle sampling", "angle-domain sampling", "角域采样", "等角度采样"),
    "variable_speed_operation": ("variable-speed", "variable speed", "start-up", "startup", "run-up", "coast-down", "coastdown"),
    "phase_response": ("phase response", "vector phase", "相位变化", "相位角"),
    "axial_vibration": ("axial vibration", "axial component", "axial direction", "axial", "轴向振动", "轴向分量", "轴向"),
    "harmonic_components": ("harmonic", "harmonics", "2x", "2X", "second harmonic", "higher harmonics", "二倍频", "谐波", "高阶谐波", "较高阶谐波"),
    "measurement_workflow": ("measurement workflow", "measurement procedure", "diagnosis workflow", "feasibility", "operating state", "operating condition", "whole train", "entire machine", "测量流程", "测量程序", "可行性", "测量的可行性", "运行状态", "工况", "整个机组", "整机"),
    "turbine_generator_unit": ("turbine-generator", "turbine generator", "gas turbine generator", "steam turbine generator", "汽轮发电机组", "燃气轮机发电机组", "透平发电机组"),
    "power_rating_50mw": ("50 mw", "50mw", "greater than 50 mw", "above 50 mw", "大于50mw", "50兆瓦"),
    "standard_analysis_measurement": ("measurement verification", "analysis and measurement", "分析评定", "测量验证"),
    "influence_vector": ("influence vector", "influence coefficient", "response vector c", "H=(T-O)/m", "T-O", "T−O", "t-0", "t−0", "影响矢量", "影响系数", "响应矢量C"),
    "trial_weight": ("trial weight", "calibration weight", "test weight", "试重", "校准配重", "m校准", "配重"),
    "complex_response_vector": ("complex vector", "complex response", "复数", "复响应"),
}
SYMBOLS: dict[str, tuple[str, ...]] = {
    "zeta": ("zeta", "ζ", "damping ratio", "阻尼比"),
    "omega_n": ("omega_n", "ωn", "natural frequency", "固有频率"),
    "omega_d": ("omega_d", "ωd", "damped natural frequency", "阻尼固有频率"),
    "Q": ("Q", "quality factor", "品质因数"),
}
STANDARD_MARKERS = ("standard", "iso", "api ", "gb/t", "规范", "标准")
SCOPE_MARKERS = ("scope", "适用范围", "范围", "适用于")
INTENTS = (
    ("standard_lookup", STANDARD_MARKERS),
    ("definition", ("define", "definition", "what is", "是什么", "定义")),
    ("comparison", ("compare", "difference", " vs ", "versus", "区别", "对比", "比较")),
    ("summary", ("summary", "summarize", "总结", "概述", "摘要")),
)
OUT_OF_SCOPE = ("autism spectrum", "balance sheet", "elevator shaft", "english modal", "modal verb", "modal verbs", "shaft of an elevator", "standard operating procedure")
STRONG = (
    "vibration", "vibrations", "vibro", "rotor", "rotordynamics", "rotor dynamics", "rotating machinery", "critical speed", "damping",
    "damping ratio", "zeta", "resonance", "frequency response", "fft", "order tracking", "balancing", "unbalance", "misalignment",
    "condition monitoring", "iso 10816", "iso 20816", "api 684",
)
STRONG_HAN = (
    "振动", "振动学", "转子", "转子动力学", "旋转机械", "轴承", "临界转速", "阻尼", "阻尼比", "模态", "固有频率", "共振", "频响", "频谱", "包络", "阶次", "轴心轨迹",
    "动平衡", "不平衡", "不对中", "轴系", "状态监测", "故障诊断",
)
WEAK_HAN, WEAK_HAN_CONTEXT = ("标准",), ("振动", "转子", "旋转机械", "轴承", "频谱", "状态监测", "故障诊断", "临界转速")
#: Standards of the corpus; a question that names one first is in scope.
CORPUS_STANDARDS = (
    "DL/T 5565", "GB/T 11348", "GB/T 13436", "GB/T 19873", "GB/T 20471", "GB/T 20921", "GB/T 22393", "GB/T 22394", "GB/T 23713", "GB/T 23718",
    "GB/T 25889", "GB/T 29531", "GB/T 29716", "GB/T 33199", "GB/T 6075", "ISO 10816",
)
WEAK = ("bearing", "modal", "orbit", "shaft", "spectrum", "spectral")
WEAK_CONTEXT = ("analysis", "diagnosis", "diagnostic", "dynamics", "fault", "frequency", "machine", "machinery", "response", "signal", "turbine", "vibration")
# Slots that an answer of an intent has to fill, each by one of its markers.
SLOTS: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "definition": (
        ("definition_statement", ("是指", "定义为", "指的是", "refers to", "is defined", "means", "角域", "angular-domain")),
        ("purpose", ("用于", "作用", "适用于", "used for", "allows", "enables")),
    ),
    "standards": (
        ("scope", ("适用于", "额定", "applies to", "rated", "scope")),
        ("specified_method", ("分析评定", "测量验证", "analysis", "measurement verification")),
    ),
}
#: Intents whose slots are filled by enough of several aspects: (name of the slot, aspects needed).
ASPECTS: dict[str, tuple[tuple[tuple[str, ...], ...], tuple[tuple[str, int], ...]]] = {
    "diagnosis": (
        (("相位", "phase"), ("倍频", "谐波", "harmonic"), ("轴向", "axial"), ("测量", "检查", "measure", "check")),
        (("multiple_diagnostic_dimensions", 2), ("decision_action", 3)),
    ),
    "workflow": (
        (("工况", "operating condition"), ("测点", "measurement point"), ("采集", "collect"), ("比较", "compare"), ("复核", "verify")),
        (("ordered_measurement_actions", 3), ("verification_step", 4)),
    ),
}
CAUSES = ("因为", "由于", "导致", "接近", "because", "due to", "causes", "approaches")
CONTRASTS = ("区别", "相比", "而", "versus", "whereas", "compared", "difference")
VARIABLES = ("式中", "其中", "表示", "where", "denotes", "represents")
PAIRED = {
    "mechanism": (("固有频率", "自然频率", "natural frequency"), ("激励频率", "转频", "excitation frequency", "forcing frequency")),
    "comparison": (("不平衡", "unbalance"), ("不对中", "misalignment")),
}
QUALITY_INTENTS = (
    ("formula", ("公式", "计算", "推导", "formula", "equation", "calculated")),
    ("standards", ("gb/t", "iso ", "api ", "标准", "适用范围", "covered by", "scope")),
    ("workflow", ("流程", "步骤", "规划", "workflow", "procedure", "steps")),
    ("definition", ("什么是", "定义", "what is", "define", "mean")),
    ("comparison", ("区别", "比较", "不同", "compare", "difference", "differ", " versus ", " vs ")),
    ("diagnosis", ("判断", "诊断", "区分", "diagnos", "distinguish", "determine")),
    ("mechanism", ("为什么", "为何", "机理", "why", "mechanism", "cause")),
)
SUMMARY_MODES = (
    ("whole_doc_summary", ("whole doc", "whole document", "整本", "全文", "全书")),
    ("section_summary", ("section", "章节", "小节", "本节")),
)
LANES = (
    ("s6_literature_search", ("literature", "paper", "papers", "publication", "research", "arxiv", "semantic scholar", "文献", "论文")),
    ("s7_model_selection", ("model", "modeling", "model selection", "which model", "模型", "建模")),
    ("s8_experiment_advice", ("experiment", "measurement", "sensor", "test plan", "validation", "实验", "测量", "传感器", "验证")),
)


def has_any(text: Column, terms) -> Column:
    """Whether the lower-cased text holds one of the terms as a substring."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(F.lower(text), F.lit(term.lower()))
    return found


def has_word(text: Column, terms) -> Column:
    """Whether the text holds one of the terms between letters and digits of none."""
    body = "|".join(re.escape(t).replace(r"\ ", r"\s+") for t in terms)
    return text.rlike(f"(?i)(?<![A-Za-z0-9])(?:{body})(?![A-Za-z0-9])")


def intent(text: Column) -> Column:
    """The first intent with a marker in the text; engineering for the rest, unknown for no text."""
    lowered, out = F.coalesce(text, F.lit("")), F.lit("engineering")
    for name, markers in reversed(INTENTS):
        out = F.when(has_any(lowered, markers), name).otherwise(out)
    return F.when(lowered == "", "unknown").otherwise(out)


def detected(text: Column, families: dict[str, tuple[str, ...]]) -> Column:
    """Names of the families with an alias in the text, in family order."""
    flags = [F.when(has_any(text, aliases), F.lit(name)) for name, aliases in families.items()]
    return F.array_compact(F.array(*flags))


def expanded(text: Column, families: dict[str, tuple[str, ...]] = FAMILIES, symbols: dict[str, tuple[str, ...]] = SYMBOLS) -> Column:
    """The squeezed text, then the distinct aliases of all detected families and symbols."""
    clean = squeeze(text)
    parts = [F.when(has_any(clean, a), F.array(*[F.lit(x) for x in a])).otherwise(F.array().cast("array<string>")) for a in [*families.values(), *symbols.values()]]
    return F.when(clean == "", F.lit("")).otherwise(F.array_join(F.array_distinct(F.concat(F.array(clean), *parts)), " "))


def coverage(question: Column, answer: Column, families: dict[str, tuple[str, ...]] = FAMILIES) -> tuple[Column, Column]:
    """(covered, total): families in the question, and those of them in the answer."""
    asked = [has_any(question, a) for a in families.values()]
    answered = [q & has_any(answer, a) for q, a in zip(asked, families.values())]
    total = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    return total(answered), total(asked)


def focus(question: Column, families: dict[str, tuple[str, ...]] = FAMILIES) -> Column:
    """The family of the longest alias in the question; the first family wins ties."""
    text = F.lower(squeeze(question))
    options = [
        F.struct(
            F.greatest(F.lit(0), *[F.when(F.contains(text, F.lit(x.lower())), len(x)).otherwise(0) for x in aliases]).alias("size"),
            F.lit(-k).alias("order"),
            F.lit(name).alias("name"),
        )
        for k, (name, aliases) in enumerate(families.items())
    ]
    best = F.greatest(*options)
    return F.when(best["size"] > 0, best["name"])


def in_scope(question: Column, override: Column | None = None, standards: tuple[str, ...] = CORPUS_STANDARDS) -> Column:
    """Domain gate: an explicit decision, else phrases that rule out, a standard of the corpus, strong terms, weak terms with context."""
    has_han = lambda terms: reduce(or_, [F.contains(question, F.lit(t)) for t in terms])
    listed = F.coalesce(first_standard(question).isin(*standards), F.lit(False))
    weak = (has_word(question, WEAK) & has_word(question, WEAK_CONTEXT)) | (has_han(WEAK_HAN) & has_han(WEAK_HAN_CONTEXT))
    gate = ~has_any(question, OUT_OF_SCOPE) & (listed | has_word(question, STRONG) | has_han(STRONG_HAN) | weak)
    return gate if override is None else F.coalesce(override, gate)


def advisory_lanes(question: Column, mode: Column) -> Column:
    """Advisory lanes in fixed order; research mode always asks for literature."""
    flags = [F.when((mode == "research") & (name == "s6_literature_search") | has_any(question, terms), F.lit(name)) for name, terms in LANES]
    return F.array_compact(F.array(*flags))


def difficulty(constraint: Column, context: Column, model: Column, failures: Column, threshold: int = 2) -> Column:
    """Constraint before context before the model's advice; repeated failures escalate to extreme."""
    known = lambda c: F.when(F.lower(F.trim(c)).isin("easy", "normal", "hard", "extreme"), F.lower(F.trim(c)))
    return F.when(failures >= threshold, "extreme").otherwise(F.coalesce(known(constraint), known(context), known(model), F.lit("normal")))


def quality_intent(question: Column) -> Column:
    """The kind of question that decides which slots an answer has to fill; general for none."""
    out = F.lit("general")
    for name, markers in reversed(QUALITY_INTENTS):
        out = F.when(has_any(question, markers), name).otherwise(out)
    return out


def filled_slots(answer: Column, intent: str) -> list[tuple[str, Column]]:
    """The slots of one intent, and whether the answer fills each."""
    if intent in SLOTS:
        return [(name, has_any(answer, markers)) for name, markers in SLOTS[intent]]
    if intent in ASPECTS:
        aspects, slots = ASPECTS[intent]
        met = sum((has_any(answer, a).cast("int") for a in aspects), F.lit(0))
        return [(name, met >= need) for name, need in slots]
    if intent in PAIRED:
        both = has_any(answer, PAIRED[intent][0]) & has_any(answer, PAIRED[intent][1])
        first, second = ("causal_link", "excitation_natural_frequency_relation") if intent == "mechanism" else ("contrast", "both_entities")
        return [(first, has_any(answer, CAUSES if intent == "mechanism" else CONTRASTS)), (second, both)]
    if intent == "formula":
        return [("equation", answer.rlike(r"[A-Za-zΑ-Ωα-ω]\w*\s*=|=\s*[^=]")), ("variable_definitions", has_any(answer, VARIABLES))]
    return [("recognized_intent", F.lit(False))]


def slot_completeness(answer: Column, intent: str) -> Column:
    """Share of the intent's slots that the answer fills."""
    return filled_share(filled_slots(answer, intent))


def filled_share(slots: list[tuple[str, Column]]) -> Column:
    return sum((F.coalesce(flag, F.lit(False)).cast("int") for _, flag in slots), F.lit(0)) / len(slots)


def completeness(question: Column, answer: Column) -> Column:
    """Slot completeness under the question's own intent; an intent that is not recognised fills nothing."""
    kind, out = quality_intent(question), F.lit(0.0)
    for name, _ in QUALITY_INTENTS:
        out = F.when(kind == name, slot_completeness(answer, name)).otherwise(out)
    return out


def summary_mode(question: Column, asked: Column | None = None) -> Column:
    """An explicit mode, else a summary of the document or of a section where the question says so, else qa."""
    out = F.lit("qa")
    for name, markers in reversed(SUMMARY_MODES):
        out = F.when(has_any(question, markers), name).otherwise(out)
    return out if asked is None else F.when(asked.isin("qa", *[n for n, _ in SUMMARY_MODES]), asked).otherwise(out)
