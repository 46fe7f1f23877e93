"""Line rules: every rule that a line matches gives one finding, in one pass over the lines."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.finding import finding
from ..functions.search import any_case, any_of, lines_held
from ..functions.text import cut, java, split_lines, strip

LLM_REFERENCE = "https://owasp.org/www-project-top-10-for-large-language-model-applications/"
LONGEST = 6000


class Rule(NamedTuple):
    rule_id: str
    title: str
    pattern: str
    severity: int
    confidence: int
    category: str
    cwe: str
    owasp: str
    fix: str
    #: Groups of words; a line without one of each group can't match, and the pattern is not tried on it.
    needs: tuple[tuple[str, ...], ...] = ()


# The rules' identifiers, patterns, ranks, categories and CWE numbers.
_INJECTION, _SUPPLY, _DISCLOSURE = "LLM01: Prompt Injection", "LLM05: Supply Chain", "LLM06: Sensitive Information Disclosure"
RULES = [
    Rule("prompt-injection-override", "Words that set earlier instructions aside",
         r"(?i)\b(ignore|disregard|forget)\b[^.\n]{0,40}\b(all\s+)?(previous|prior|above|earlier|the\s+system|your)\b[^.\n]{0,20}\b(instruction|prompt|rule|direction|context)",
         3, 1, "PROMPT_INJECTION", "CWE-77", _INJECTION, "Hand the text to a model as data, marked off from what the model is told to do.",
         (("ignore", "disregard", "forget"), ("instruction", "prompt", "rule", "direction", "context"))),
    Rule("prompt-injection-new-instructions", "Heading that announces other instructions",
         r"(?i)\b(new|updated|revised|real|actual)\s+(instruction|system\s+prompt|directive|task)s?\s*[:\-]",
         2, 0, "PROMPT_INJECTION", "CWE-77", _INJECTION, "Let no document announce tasks to whoever reads it; take the heading out.",
         ((":", "-"), ("instruction", "system", "directive", "task"))),
    Rule("prompt-injection-role-hijack", "Words that give the reader another role",
         r"(?i)\b(you\s+are\s+now|from\s+now\s+on\s+you|act\s+as\s+(an?\s+)?(unrestricted|jailbroken|dan|developer\s+mode)|do\s+anything\s+now|pretend\s+you\s+have\s+no\s+(rules|restrictions))\b",
         3, 1, "PROMPT_INJECTION", "CWE-77", _INJECTION, "Take roles from the system prompt alone and drop such lines from documents.",
         (("now", "unrestricted", "jailbroken", "dan", "developer", "pretend"), ("you", "act", "anything", "pretend"))),
    Rule("prompt-injection-system-role", "Chat role marker inside a document",
         r"(?im)^\s*(?:<\|?(system|assistant)\|?>|\[/?(system|inst)\]|###\s*system\s*:|system\s+prompt\s*:)",
         2, 0, "PROMPT_INJECTION", "CWE-77", _INJECTION, "Escape role markers before the document becomes part of a chat.",
         (("system", "assistant", "inst]"),)),
    Rule("agent-directed-imperative", "Order to an assistant inside a document",
         r"(?i)\b(assistant|claude|chatgpt|gpt|copilot|the\s+ai|the\s+agent|the\s+model)\s*,?\s+(please\s+)?(run|execute|curl|wget|send|email|forward|delete|exfiltrate|post|upload|fetch|disable|ignore)\b",
         3, 1, "PROMPT_INJECTION", "CWE-77", _INJECTION, "Find out who wrote the order and why; documents have no say in what an assistant runs.",
         (("ai", "agent", "model", "assistant", "claude", "gpt", "copilot"), ("the", "assistant", "claude", "gpt", "copilot"), ("run", "execute", "curl", "wget", "send", "email", "forward", "delete", "exfiltrate", "post", "upload", "fetch", "disable", "ignore"))),
    Rule("safety-bypass-instruction", "Words that switch off checks or approvals",
         r"(?i)\b(auto[\-\s]?approve|disable\s+(the\s+)?(safety|guard|guardrail|confirmation|sandbox|protection)|bypass\s+(the\s+)?(gate|approval|permission|review|check)|skip\s+(the\s+)?(review|audit|confirmation|approval|permission)|without\s+(asking|confirmation|approval|human)|no\s+confirmation\s+needed)\b",
         3, 1, "SAFETY_BYPASS", "CWE-807", _INJECTION, "Let a person decide on every step that the line wants to leave unchecked.",
         (("approve", "disable", "bypass", "skip", "without", "confirmation"),)),
    Rule("dangerous-permission-flag", "Option that skips permission prompts",
         r"(?i)(--dangerously-skip-permissions|--yes-really|--no-verify\b|--disable-sandbox|--allow-all|acceptAll|autoApprove\s*[:=]\s*true)",
         3, 1, "SAFETY_BYPASS", "CWE-250", _INJECTION, "Leave the option out of files that others run; give it by hand where it is needed.",
         (("--", "acceptall", "autoapprove"),)),
    Rule("privilege-escalation", "Command that raises privileges or opens files to all",
         r"(?i)\b(sudo\s+\S|chmod\s+777|chmod\s+-R\s+777|run\s+as\s+root|setuid)\b",
         2, 0, "SAFETY_BYPASS", "CWE-250", _INJECTION, "Run the step as an ordinary user and name the exact rights that it needs.",
         (("sudo", "chmod", "root", "setuid"),)),
    Rule("remote-code-pipe", "Download that is handed to a shell",
         r"(?i)\b(curl|wget)\b[^\n|]{0,200}\|\s*(sudo\s+)?(sh|bash|zsh|python[0-9.]*|node|pwsh|powershell)\b",
         3, 2, "EXFIL", "CWE-494", _SUPPLY, "Save the script, compare its checksum with a known one, read it and only then run it.",
         (("|",), ("curl", "wget"))),
    Rule("powershell-download-exec", "Download that PowerShell evaluates",
         r"(?i)(Invoke-Expression|iex)\b[^\n]{0,80}(Invoke-WebRequest|iwr|DownloadString|Net\.WebClient)",
         3, 2, "EXFIL", "CWE-494", _SUPPLY, "Save what is fetched and look at it before anything evaluates it.",
         (("iex", "invoke-expression"), ("invoke-webrequest", "iwr", "downloadstring", "net.webclient"))),
    Rule("sensitive-file-read", "Path of a credential store",
         r"(?i)(~|\$HOME|%USERPROFILE%)?[/\\]?\.(aws/credentials|ssh/id_[a-z0-9]+|ssh/id_rsa|netrc|npmrc|docker/config\.json|kube/config|config/gcloud|gnupg)\b|\bid_rsa\b",
         2, 0, "EXFIL", "CWE-200", _DISCLOSURE, "Find out what the file is needed for, and hand the one credential over by other means.",
         (("/", ".n", ".gnupg", "id_rsa"), (".aws/", ".ssh/", ".netrc", ".npmrc", ".docker/", ".kube/", ".config/", ".gnupg", "id_rsa"))),
    Rule("env-exfil", "Environment variables that go to the network",
         r"(?i)\b(printenv|env\b|os\.environ|process\.env|Get-ChildItem\s+env:)[^\n]{0,120}\b(curl|wget|fetch|requests\.(post|get)|Invoke-WebRequest|http\.client|axios|urllib)\b",
         3, 1, "EXFIL", "CWE-200", _DISCLOSURE, "Send single named values in place of the environment, which usually holds secrets.",
         (("env", "os.environ"), ("curl", "wget", "fetch", "requests.", "invoke-webrequest", "http.client", "axios", "urllib"))),
    Rule("base64-exfil", "Encoded data that goes to the network",
         r"(?i)\bbase64\b[^\n|]{0,60}\|[^\n]{0,60}\b(curl|wget|nc|ncat)\b",
         3, 1, "EXFIL", "CWE-200", _DISCLOSURE, "Find out what is encoded here, and who receives it.",
         (("|",), ("base64",), ("curl", "wget", "nc"))),
    Rule("dns-exfil", "Host name made from the output of a command",
         r"(?i)\b(nslookup|dig|host)\b[^\n]{0,60}\$\(|\bcurl\b[^\n]{0,60}\.(?:oast|burpcollaborator|interact\.sh|requestbin)\b",
         2, 0, "EXFIL", "CWE-200", _DISCLOSURE, "Look up fixed names only; names made of data tell that data to whoever answers.",
         (("nslookup", "dig", "host", "curl"), ("$(", "oast", "burpcollaborator", "interact.sh", "requestbin"))),
]



def lines_of(files: DataFrame, *more: str) -> DataFrame:
    """(path, line_no, line) and further columns of the file; lines are numbered from 1."""
    return files.select("path", *more, F.posexplode(split_lines("text")).alias("at", "line")).select("path", *more, (F.col("at") + 1).alias("line_no"), "line")


def _may(folded: str, rule: Rule) -> Column:
    """Whether a text in folded case has a word of each group that the rule needs."""
    out = F.lit(True)
    for group in rule.needs:
        out = out & reduce(or_, [F.contains(F.col(folded), F.lit(w)) for w in group])
    return out


def _folded(text: str) -> Column:
    # letters that only fold to ASCII by way of upper case are needed too; lower(upper()) would not do, as Catalyst makes it lower()
    low = F.lower(text)
    other = low
    for letter, plain in (("\u017f", "s"), ("\u0131", "i"), ("i\u0307", "i")):
        other = F.replace(other, F.lit(letter), F.lit(plain))
    return F.when(F.octet_length(text) > F.length(text), other).otherwise(low)


def settled(rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """``rows``, or those to keep, with columns that later filters read as they are: without the row number, Catalyst would copy what makes them into each filter."""
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    return numbered.where((F.col("__row") >= 0) & (F.lit(True) if keep is None else keep)).drop("__row")


def words_held(rules: list[Rule] = RULES) -> list[tuple[str, ...]]:
    """For each rule the patterns of the words that it needs, as tests of a text or a line: the group of the longest words first, as the rarest."""
    rarest = lambda group: (min(map(len, group)), len(group))
    return [tuple(any_of([any_case(w) for w in g]) for g in sorted(r.needs, key=rarest, reverse=True)) for r in rules]


def with_line_facts(lines: DataFrame) -> DataFrame:
    """Lines with ``candidates``, the numbers of the rules whose words they have, and with what ``rule_hits`` reads of each: its folded case and whether it is ASCII."""
    some = (F.size("candidates") > 0) & (F.length("line") <= LONGEST)
    return settled(lines.withColumns({"folded": F.when(some, _folded("line")), "ascii": F.octet_length("line") == F.length("line")}))


def rule_hits(rules: list[Rule] = RULES) -> Column:
    """Numbers of the rules that a line with its facts matches; none for lines of over 6,000 characters."""
    hits = []
    for i, r in enumerate(rules):
        matches = F.when(F.col("ascii"), F.col("line").rlike(java(r.pattern, ascii_only=True))).otherwise(F.col("line").rlike(java(r.pattern)))
        # nested, because AND does not promise an order
        hits.append(F.when(F.array_contains("candidates", i), F.when(_may("folded", r), F.when(matches, F.lit(i)))))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.when(F.col("folded").isNotNull(), found).otherwise(F.array().cast("array<int>"))


def from_rule_hits(rows: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(path, line_no, line, rules) -> findings."""
    rows = rows.select("path", "line_no", "line", F.explode("rules").alias("i"))

    def of(field: str) -> Column:
        return F.element_at(F.array(*[F.lit(getattr(r, field)) for r in rules]), F.col("i") + 1)

    made = finding(
        "aisec", 6, rule=F.col("i"), rule_id=of("rule_id"), title=of("title"), severity=of("severity"), confidence=of("confidence"), file=F.col("path"), line=F.col("line_no"),
        category=of("category"), description=F.concat(of("title"), F.lit(".")), snippet=cut(strip(F.col("line")), 200), fix=of("fix"), cwe=of("cwe"), owasp=of("owasp"),
        references=F.array(F.lit(LLM_REFERENCE)),
    )
    return rows.select(made.alias("f")).select("f.*")


def line_findings(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The findings of line rules over files in scope."""
    lines = files.where("in_scope").select("path", F.inline(lines_held("text", words_held(rules)))).withColumnRenamed("held", "candidates")
    lines = with_line_facts(lines)
    hits = lines.select("path", "line_no", "line", rule_hits(rules).alias("rules"))
    return from_rule_hits(settled(hits, F.size("rules") > 0), rules)
