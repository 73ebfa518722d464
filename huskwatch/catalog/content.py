"""Detection content keyed by technique, and hardening advice.

Each entry is data: title, tactics, selectors (any / all / re over the script text) and a boolean
condition over selector names.  Platform texts are rendered from the entry by one format per
platform, so new techniques need data only.
"""
from __future__ import annotations

# Technique -> (title, mitre id, tactics, selectors, condition).
CONTENT = {
    "AMSI_BYPASS_REFLECT": ("PowerShell AMSI bypass via .NET reflection", "T1562.001", ["defense_evasion"], {
        "sel_init": ("any", ["amsiInitFailed"]), "sel_buf": ("any", ["AmsiScanBuffer"]),
        "sel_ref": ("all", ["GetField", "amsi"])}, "sel_init or sel_buf or sel_ref"),
    "AMSI_BYPASS_COM": ("PowerShell AMSI bypass via COM object", "T1562.001", ["defense_evasion"], {
        "selection": ("any", ["IAmsiStream", "AmsiInitialize", "amsi.AMSI"])}, "selection"),
    "DOWNLOAD_CRADLE_WC": ("PowerShell download cradle via Net.WebClient", "T1105", ["command_and_control"], {
        "sel_dl": ("any", ["DownloadString", "DownloadFile", "DownloadData"]), "sel_wc": ("any", ["Net.WebClient"]),
        "sel_iex": ("any", ["IEX", "Invoke-Expression"])}, "(sel_dl and sel_wc) or (sel_wc and sel_iex)"),
    "DOWNLOAD_CRADLE_BITS": ("PowerShell BITS transfer download cradle", "T1197", ["defense_evasion"], {
        "selection": ("any", ["Start-BitsTransfer", "BitsTransfer"])}, "selection"),
    "REFLECTIVE_INJECT": ("PowerShell reflective PE injection", "T1055.001", ["defense_evasion", "privilege_escalation"], {
        "sel_name": ("any", ["Invoke-ReflectivePEInjection", "Invoke-ReflectiveDllInjection"]),
        "sel_api": ("all", ["VirtualAlloc", "WriteProcessMemory"])}, "sel_name or sel_api"),
    "SHELLCODE_MARSHAL": ("PowerShell shellcode via Runtime.InteropServices.Marshal", "T1055", ["defense_evasion"], {
        "selection": ("all", ["AllocHGlobal", "GetDelegateForFunctionPointer"])}, "selection"),
    "CRED_HARVEST": ("PowerShell Mimikatz / credential harvesting", "T1003.001", ["credential_access"], {
        "selection": ("any", ["sekurlsa", "Invoke-Mimikatz", "DumpCreds", "lsadump::", "kerberos::"])}, "selection"),
    "WMI_PERSIST": ("PowerShell WMI event subscription persistence", "T1546.003", ["persistence"], {
        "selection": ("any", ["__EventFilter", "ActiveScriptEventConsumer", "__FilterToConsumerBinding"])}, "selection"),
    "COBALT_STRIKE": ("PowerShell Cobalt Strike stager indicators", "T1059.001", ["execution"], {
        "sel_iex": ("all", ["IEX", "New-Object", "Net.WebClient", "DownloadString"]),
        "sel_gzip": ("all", ["GzipStream", "FromBase64String"]), "sel_doit": ("any", ["$DoIt"])},
        "sel_iex or sel_gzip or sel_doit"),
    "REVERSE_SHELL": ("PowerShell TCP reverse shell", "T1059.001", ["command_and_control"], {
        "sel_tcp": ("any", ["Net.Sockets.TcpClient", "System.Net.Sockets.TcpClient"]),
        "sel_stream": ("all", ["GetStream", "StreamReader"])}, "sel_tcp or sel_stream"),
    "ETW_BYPASS": ("PowerShell ETW bypass", "T1562.006", ["defense_evasion"], {
        "selection": ("any", ["EtwEventWrite", "PatchEtw", "EtwEventWriteFull"])}, "selection"),
    "AV_EXCLUSION": ("PowerShell Defender exclusion or disable", "T1562.001", ["defense_evasion"], {
        "selection": ("any", ["Add-MpPreference -ExclusionPath", "Set-MpPreference -DisableRealtimeMonitoring",
                              "DisableAntiSpyware"])}, "selection"),
    "ENCODED_CMD": ("PowerShell encoded command execution", "T1059.001", ["execution"], {
        "selection": ("re", [r"-E(nc(odedCommand)?|C)\s+[A-Za-z0-9+/]{20,}"])}, "selection"),
    "HIGH_ENTROPY_BLOB": ("PowerShell high-entropy script block (possible encoded payload)", "T1059.001", ["execution"], {
        "selection": ("re", [r"[A-Za-z0-9+/]{200,}={0,2}"]),
        "filter": ("any", ["# Copyright", "param(", "function "])}, "selection and not filter"),
}

PLATFORMS = ["kql", "spl", "aql", "eql", "yaral", "yara"]

# One text per (platform, selector mode): how a term test is written.
_TERM = {
    "kql": ('EventData has "{t}"', 'EventData matches regex "{t}"'),
    "spl": ('Message="*{t}*"', 'match(Message, "{t}")'),
    "aql": ("UTF8(payload) ILIKE '%{t}%'", "UTF8(payload) IMATCHES '{t}'"),
    "eql": ('winlog.event_data.ScriptBlockText like~ "*{t}*"', 'winlog.event_data.ScriptBlockText regex~ ".*{t}.*"'),
    "yaral": ("re.regex($e.principal.process.command_line, `{t}`) nocase",) * 2,
}
_FRAME = {
    "kql": "// {title} ({mitre})\nEvent | where EventID == 4104 | where {cond}",
    "spl": "| comment \"{title} ({mitre})\"\nindex=wineventlog EventCode=4104 ({cond})",
    "aql": "-- {title} ({mitre})\nSELECT * FROM events WHERE eventid=4104 AND ({cond})",
    "eql": "// {title} ({mitre})\nany where event.code == \"4104\" and ({cond})",
    "yaral": "rule {name} {{ meta: mitre_technique = \"{mitre}\" events: $e.metadata.product_event_type = \"4104\" ({cond}) condition: $e }}",
    "yara": "rule {name} {{ meta: mitre_technique = \"{mitre}\" strings: {strings} condition: {cond} }}",
}


def _yara(name: str, mitre: str, selectors: dict, condition: str) -> str:
    strings, cond = [], f" {condition} "
    for sel, (mode, terms) in selectors.items():
        ids = []
        for t in terms:
            ids.append(f"$s{len(strings)}")
            strings.append(f"{ids[-1]} = /{t}/" if mode == "re" else f'{ids[-1]} = "{t}" nocase')
        cond = _swap(cond, sel, "(" + (" and " if mode == "all" else " or ").join(ids) + ")")
    return _FRAME["yara"].format(name=name, mitre=mitre, strings=" ".join(strings), cond=cond.strip())


def _swap(cond: str, selector: str, text: str) -> str:
    for left in (" ", "("):
        for right in (" ", ")"):
            cond = cond.replace(f"{left}{selector}{right}", f"{left}{text}{right}")
    return cond


def render(platform: str, technique: str, title: str, mitre: str, selectors: dict, condition: str) -> str:
    """Query text of one technique for one platform."""
    name = "script_" + technique.lower()
    if platform == "yara":
        return _yara(name, mitre, selectors, condition)
    cond = f" {condition} "
    for sel, (mode, terms) in selectors.items():
        plain, regex = _TERM[platform]
        tests = [(regex if mode == "re" else plain).format(t=t) for t in terms]
        cond = _swap(cond, sel, "(" + (" and " if mode == "all" else " or ").join(tests) + ")")
    return _FRAME[platform].format(name=name, title=title, mitre=mitre, cond=cond.strip())


def content_rows() -> list[tuple]:
    rows = []
    for tech, (title, mitre, tactics, selectors, condition) in CONTENT.items():
        tags = [f"attack.{t}" for t in tactics] + [f"attack.{mitre.lower()}"]
        rows.append((tech, title, mitre, tags, condition,
                     {p: render(p, tech, title, mitre, selectors, condition) for p in PLATFORMS}))
    return rows


def content_table(spark):
    return spark.createDataFrame(
        content_rows(), "technique_id string, title string, mitre string, tags array<string>, condition string, texts map<string,string>")


# Advice themes per technique: what to restrict, and how urgent.
_THEMES = [
    ("AMSI_BYPASS_REFLECT", "script-engine scan tampering", "critical"), ("AMSI_BYPASS_COM", "scan-interface abuse", "critical"),
    ("DOWNLOAD_CRADLE_WC", "script downloads from the network", "high"), ("REFLECTIVE_INJECT", "in-memory module loading", "critical"),
    ("SHELLCODE_MARSHAL", "native code run from scripts", "critical"), ("CRED_HARVEST", "credential memory access", "critical"),
    ("WMI_PERSIST", "event-subscription persistence", "high"), ("COBALT_STRIKE", "known stager behaviour", "critical"),
    ("REVERSE_SHELL", "outbound shells from scripts", "critical"), ("ETW_BYPASS", "event-tracing tampering", "high"),
    ("AV_EXCLUSION", "protection exclusions", "high"), ("ENCODED_CMD", "encoded script commands", "medium"),
]
_PRODUCTS = [("falcon", "CrowdStrike Falcon", ()), ("defender", "Microsoft Defender for Endpoint", ("SHELLCODE_MARSHAL",)),
             ("s1", "SentinelOne", ()), ("cortex", "Palo Alto Cortex XDR", ())]
_GENERAL = [("Set script prevention to block mode", "critical"), ("Turn on tamper protection", "high"),
            ("Collect script-block logs centrally", "high"), ("Review exclusions every month", "medium")]


def advice_rows() -> list[tuple]:
    """(product, product_name, technique_id or '', title, priority, steps); the caller may pass its own."""
    rows = []
    for slug, name, skipped in _PRODUCTS:
        for title, priority in _GENERAL:
            rows.append((slug, name, "", title, priority, [f"Open the {name} policy that covers script hosts.", f"{title}.", "Roll out by group and watch for breakage."]))
        for tech, what, priority in _THEMES:
            if tech not in skipped:
                rows.append((slug, name, tech, f"Restrict {what}", priority, [
                    f"Open the {name} policy that covers script hosts.", f"Switch the control for {what} from audit to block.",
                    "Confirm with a test script on one pilot group."]))
    return rows


def advice_table(spark):
    return spark.createDataFrame(advice_rows(), "product string, product_name string, technique_id string, title string, priority string, steps array<string>")
