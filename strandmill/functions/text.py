"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = " \t\n\r\f\x0b"
#: What marks a line as page furniture of a paper.
METADATA = (
    r"\b(?:DOI|doi)\s*[:：]\s*10\.\d{4,}/",
    r"arXiv\s*[:：]\s*\d{4}\.\d{4,}",
    r"(?:Published|Received|Accepted|Submitted)\s*[:：]?\s*\d{1,2}\s+[\p{L}\p{N}_]+\s+\d{4}",
    r"\d{4}\s*(?:IEEE|ACM|Springer|Elsevier|CVPR|ICCV|NeurIPS|ICML|ICLR|AAAI|ACL|EMNLP)",
    r"[©]\s*\d{4}",
    r"https?://[^\s]{10,}",
    r"^\d{1,3}\s*$",
)
#: What marks a short line as an affiliation.
AFFILIATION = (
    r"(?:Department|School|College|Institute|Laboratory|Lab)\s+of\s+[\p{L}\p{N}_]+",
    r"University\s+of\s+[\p{L}\p{N}_]+",
    r"[\p{L}\p{N}_]+@[\p{L}\p{N}_]+\.[\p{L}\p{N}_]+",
)
#: Remarks of a translator about the translation.
REMARKS = (
    r"(?im)(?:以下|好的|OK|Sure|Here)[,，].*?(?:翻译|部分|translation).*?[：:]\s*",
    r"(?im)^#{1,4}\s*翻译(?:结果|内容|文本|译文)?\s*$",
    r"(?m)^#{1,4}\s*第\s*\d+\s*/\s*\d+\s*部分\s*$",
    r"(?m)^第\s*\d+\s*/\s*\d+\s*部分.*?(?:翻译)?\s*$",
    r"(?im)^#{1,4}\s*(?:Translation|Chinese\s+Translation)\s*$",
)
#: Thinking blocks and stray markers, in the order in which they are removed.
THINKING = (
    r"(?s)<think>.*?</think>",
    r"(?s)^\s*<think>.*$",
    r"(?s)<thought>.*?</thought>",
    r"(?s)^\s*<thought>.*$",
    r"<think(?![A-Za-z0-9_\-:>/])",
    r"<thought(?![A-Za-z0-9_\-:>/])",
    r"^\s*</think>\s*",
    r"\s*</think>\s*$",
    r"^\s*</thought>\s*",
    r"\s*</thought>\s*$",
    r"^\s*<\|?channel\|?>\s*",
)
#: Topics and the strings that show them.
TOPICS = {
    "强化学习": ("reinforcement learning", "RL", "MARL", "MADRL", "DQN", "PPO", "A3C", "SAC", "TD3", "Q-learning", "Actor-Critic", "multi-agent"),
    "深度学习": ("deep learning", "DNN", "CNN", "RNN", "LSTM", "Transformer", "attention", "neural network"),
    "图神经网络": ("graph neural", "GNN", "GCN", "GAT", "GATAC", "graph attention", "graph convolution"),
    "无人机/机器人": ("UAV", "drone", "robotics", "robot", "aerial", "multi-rotor", "quadcopter", "fixed-wing"),
    "优化算法": ("optimization", "gradient descent", "SGD", "Adam", "convex", "non-convex", "Lagrangian", "dual", "trajectory"),
    "通信网络": ("communication", "wireless", "5G", "6G", "IoT", "RSSI", "channel", "beamforming", "MIMO", "NOMA"),
    "边缘/云计算": ("edge computing", "cloud", "federated learning", "distributed", "MEC", "computation offloading"),
    "计算机视觉": ("computer vision", "object detection", "segmentation", "image", "video", "YOLO", "ResNet"),
    "自然语言处理": ("NLP", "language model", "LLM", "GPT", "BERT", "transformer", "text", "embedding"),
    "资源分配": ("resource allocation", "scheduling", "power control", "bandwidth", "spectrum", "energy efficiency"),
}
#: Section categories, the first that matches wins.
CATEGORIES = (
    ("通信模型|信道模型|SINR|SNR|香农|NOMA|路径损耗|LoS|传输速率|衰落|Nakagami", "通信模型"),
    ("计算模型|计算时延|计算能耗|本地计算|边缘计算|卸载|MEC|任务处理|队列", "计算模型"),
    ("能耗模型|推进功率|飞行能耗|悬停能耗|能量模型|电池|DVFS", "能耗模型"),
    ("AoI|AoT|信息年龄|Age of|AoI模型|AoT模型", "AoI"),
    ("DQN|DDPG|A3C|MAPPO|MADDPG|MATD3|MASAC|PPO|Actor|Critic|RL|强化学习|状态.*动作.*奖励|策略|观测", "RL模型"),
    ("问题表述|P1|优化问题|目标函数|min.*\\\\max|约束", "优化问题"),
    ("控制模型|移动模型|轨迹|位置更新|速度|运动学|动力学", "控制模型"),
    ("感知模型|雷达|感知数据|覆盖半径|FOV|探测", "感知模型"),
    ("DT模型|数字孪生", "数字孪生"),
    ("覆盖模型|覆盖评分|覆盖判据|公平指数", "覆盖模型"),
    ("Cobb.*Douglas|效用函数|经济成本", "效用模型"),
)
NO_CATEGORY = "其他"


def beyond(chars: str) -> str:
    """A class of characters none of which is ASCII, in a form that passes over ASCII with one test instead of one a range."""
    return rf"(?=[^\x00-\x7F]){chars}"


#: Runs of white space that are not one blank already.
BLANKS = r"\s(?:\s+|(?<=[^ ]))"
CJK = beyond("[一-鿿]")
CJK_WIDE = beyond("[一-鿿㐀-䶿]")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters are of a class: by how much a text gets shorter without its runs, with no match to build for every one."""
    return F.length(text) - F.length(F.regexp_replace(text, chars + "+", ""))


def any_pattern(c: Column, patterns: tuple[str, ...]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and _; a run of ideographs is one token."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def sections(text: Column) -> Column:
    """Array of (head, body): parts between blank lines, headed by the first 40 characters of their first line."""
    parts = F.filter(F.transform(F.split(text, r"\n{2,}", -1), strip), lambda p: p != "")
    whole = F.array(F.struct(F.lit("全文").alias("head"), strip(text).alias("body")))

    def one(p: Column) -> Column:
        first = F.substring_index(p, "\n", 1)
        rest = strip(p.substr(F.length(first) + 1, F.length(p)))
        return F.struct(F.substring(first, 1, 40).alias("head"), F.when(rest == "", p).otherwise(rest).alias("body"))

    return F.when(F.size(parts) == 0, whole).otherwise(F.transform(parts, one))


def truncate(text: Column, most: int, suffix: str = "\n... (truncated)") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(suffix))).otherwise(text)


def truncate_at_sentence(text: Column, most: int) -> Column:
    """Cut at the last sentence end within ``most`` if that keeps more than half, else hard with an ellipsis."""
    head = F.substring(text, 1, most)
    kept = F.regexp_extract(head, r"(?s)^(.*[。.!?！？])", 1)
    return F.when(F.length(text) <= most, text).when(F.length(kept) > most / 2, kept).otherwise(F.concat(head, F.lit("…")))


def normal_paragraph(p: Column) -> Column:
    """The form in which paragraphs are compared."""
    out = F.regexp_replace(strip(p), r"^#{1,4}\s*", "")
    for pattern, to in ((r"(?s)\$\$.*?\$\$", "█MATH█"), (r"\$[^$\n]*?\$", "█INLINE█"), (r"◈[A-Z]+_\d+◈", "█PH█"), (BLANKS, " "), (r"[,.!?:;\-]|" + beyond("[，。！？、；：（）《》【】]"), "")):
        out = F.regexp_replace(out, pattern, to)
    return F.lower(strip(out))


def strip_remarks(text: Column) -> Column:
    for p in REMARKS:
        text = F.regexp_replace(text, p, "")
    return strip(text)


def strip_thinking(text: Column) -> Column:
    for p in THINKING:
        text = F.regexp_replace(text, p, "")
    return strip(text)


def strip_tags(html: Column) -> Column:
    """Text of HTML: without scripts, styles and tags; the five basic entities and the blank are decoded."""
    for p in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>"):
        html = F.regexp_replace(html, p, "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        html = F.replace(html, F.lit(name), F.lit(char))
    return strip(html)


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t](?:[ \t]+|(?<=\t))", " "), r"\n{3,}", "\n\n"))


def to_markdown(html: Column) -> Column:
    """Links, headings, items and breaks of HTML as Markdown."""
    out = F.regexp_replace(html, r"""(?is)<a\s+[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""", "[$2]($1)")
    for n in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n" + "#" * n + " $1\n")
    out = F.regexp_replace(out, r"(?is)<li[^>]*>(.*?)</li>", "\n- $1")
    out = F.regexp_replace(out, r"(?i)</(?:p|div|section|article)>", "\n\n")
    out = F.regexp_replace(out, r"(?i)<(?:br|hr)\s*/?>", "\n")
    return squeeze(strip_tags(out))


def english_ratio(p: Column) -> Column:
    """(ratio, cjk): share of ASCII letters and number of ideographs, without mathematics, placeholders and tags."""

    def plain(q: Column) -> Column:
        for pattern in (r"(?s)\$\$.*?\$\$", r"\$[^$\n]*?\$", r"◈[A-Z]+_\d+◈", r"</?[^>]+>"):
            q = F.regexp_replace(q, pattern, "")
        return q

    def measured(q: Column) -> Column:
        size = F.length(strip(q))
        ratio = F.when(size == 0, F.lit(0.0)).otherwise(count_chars(q, "[a-zA-Z]") / size)
        return F.struct(ratio.alias("ratio"), F.when(size == 0, F.lit(0)).otherwise(count_chars(q, CJK_WIDE)).alias("cjk"))

    return bound(F.when(p.rlike("[$◈<]"), plain(p)).otherwise(p), measured)


def language(text: Column) -> Column:
    """zh with at least 200 ideographs that are more than a fifth of the letters, else en."""
    cjk = count_chars(text, CJK)
    alpha = count_chars(text, "[a-zA-Z]")
    return F.when((cjk >= 200) & (cjk > 0.2 * (cjk + alpha)), "zh").otherwise("en")


def title(text: Column) -> Column:
    """The first line with something in it of the first 800 characters, the second if that has fewer than 10."""
    found = F.filter(F.transform(lines(F.substring(text, 1, 800)), strip), lambda x: x != "")
    first = F.get(found, F.lit(0))
    return F.substring(F.when((F.length(first) < 10) & (F.size(found) > 1), F.get(found, F.lit(1))).otherwise(first), 1, 300)


def without_metadata_lines(text: Column) -> Column:
    def keep(line: Column) -> Column:
        """What marks a line has a digit or is an address, of an affiliation " of " or "@"; only lines with that are matched."""
        s = strip(line)
        metadata = s.rlike("[0-9]|http") & any_pattern(s, METADATA)
        affiliation = (F.length(s) < 120) & s.rlike("of|@") & any_pattern(s, AFFILIATION)
        return (F.length(s) >= 3) & ~metadata & ~affiliation

    return F.array_join(F.filter(lines(text), keep), "\n")


def without_diagram_labels(text: Column) -> Column:
    """Drops lines that look like labels of a drawing: short parts between slashes, few words with one repeated, a mix of short scraps of two scripts."""

    def label(line: Column) -> Column:
        s = strip(line)
        parts = F.filter(F.transform(F.split(s, "/", -1), strip), lambda x: x != "")
        words = F.filter(F.split(s, r"\s+", -1), lambda x: x != "")
        slashes = (F.size(parts) >= 3) & F.forall(parts, lambda x: F.length(x) <= 25) & ~s.rlike(r"[.。!！?？]\s+[A-Z一-鿿]")
        again = F.size(words).between(3, 6) & (F.size(F.array_distinct(words)) < F.size(words))
        scraps = F.size(F.filter(words, lambda x: F.length(x) <= 3)) >= 4
        soup = (F.size(words) >= 5) & scraps & F.exists(words, lambda x: x.rlike(CJK)) & F.exists(words, lambda x: x.rlike("^[a-zA-Z0-9,]+$")) & ~s.rlike("[。.，,！!？?]")
        return (s != "") & (slashes | again | soup)

    return F.array_join(F.filter(lines(text), lambda x: ~label(x)), "\n")


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def topics(text: Column) -> Column:
    def shown(low: Column) -> Column:
        some = lambda pats: reduce(lambda a, b: a | b, [low.contains(p.lower()) for p in pats])
        return F.array_compact(F.array(*[F.when(some(pats), F.lit(name)) for name, pats in TOPICS.items()]))

    return bound(F.lower(text), shown)


def any_of(text: Column, pattern: str) -> Column:
    """Whether a pattern of alternatives without groups matches: plain ones are looked for as they are, one with gaps (.*) is matched where all its parts are there."""

    def found(alternative: str) -> Column:
        parts = [re.sub(r"\\(\W)", r"\1", p) for p in alternative.split(".*")]
        there = reduce(lambda a, b: a & b, [text.contains(p) for p in parts])
        return there if len(parts) == 1 else F.when(there, text.rlike(alternative)).otherwise(F.when(text.isNotNull(), False))

    return reduce(lambda a, b: a | b, map(found, pattern.split("|")))


def category(heading: Column) -> Column:
    out = F.when(F.lit(False), "")
    for pattern, name in CATEGORIES:
        out = out.when(any_of(heading, pattern), name)
    return out.otherwise(NO_CATEGORY)


def token_estimate(text: Column) -> Column:
    """Characters over four and four more, at least four."""
    return F.greatest(F.lit(4), F.floor(F.length(text) / 4) + 4).cast("long")


def glob_to_regex(glob: str) -> str:
    """* and ? stay within a path part, ** crosses parts."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in r".^$+{}[]()|\\" else glob[i]), i + 1
    return f"^{out}$"
