"""Values the data itself dictates.

Everything in this module is a fixed value: an identifier, name or list that
archives and logs already written in the wild contain, so it has to be equal
here for results to be right.  No logic lives in this file.
"""

# --- fixed values: ids of log messages ---------------------------------------
MSG_STATS = "24d92d16-770e-4088-b769-4020e127a7ff"
MSG_EXIT = "9b1bd603-f7cd-4745-895a-5b894a5166f2"
MSG_LINKS = "8ee5e9c9-1130-4c5c-88ff-718508546e0c"
MSG_RECURSION = "5b8498e4-868d-413c-a67e-004516b8452c"
MSG_FETCH = "d1288fbe-8bae-42c8-af8c-f2fa8b41794f"
MSG_SCHEME_IGNORED = "57e838de-4494-4316-ae98-cd3a2ebf541b"
MSG_QUEUED = "36cc34a6-061b-4cc5-84a9-4ab6552c8d75"
MSG_STARTED = "46e62d60-f498-4ab0-90e1-d08a073b10fb"
MSG_FORWARDED = "5c0f9a11-dcd8-4182-a60f-54f4d3ab3687"
MSG_FINISHED = "7b40ffbb-faab-4224-90ed-cd4febd8f7ec"
MSG_ABORTED = "865b3b3e-a54a-4a56-a545-f38a37bac295"
MSG_RESPONSE_MISSING = "fac3ab96-3f9b-4c5a-95c7-f83b675cdcb9"
MSG_REQUEST_EXISTS = "2c989142-ba00-4791-bb03-c2a14e91a56b"
MSG_REDIRECT = "85eaec41-e2a9-49c2-9445-6f19690278b8"
MSG_CONSOLE = "e62ffb5a-0521-459c-a3d9-1124551934d2"

# chat connection noise, never forwarded to the live feed
FEED_IGNORED_MESSAGES = (
    "01f7b138-ea53-4609-88e9-61f3eca3e7e7",
    "367063a5-9069-4025-907c-65ba88af8593",
    "4c74b2c8-2403-4921-879d-2279ad85db72",
    "c53555cb-e1a4-4b69-b1c9-3320269c19d7",
)

# --- fixed values: known data errors -----------------------------------------
ERRATA_PRE_RELEASE = "34a176b3-ad3d-430f-a082-68087f304572"
ERRATA_CONTENT_TYPE = "552c13dc-56e5-4539-9ad8-184ccae60930"

# --- fixed values: log levels -------------------------------------------------
LEVEL_DEBUG, LEVEL_INFO, LEVEL_WARNING, LEVEL_ERROR = 0, 1, 2, 3
CONSOLE_LEVELS = {"verbose": 0, "info": 1, "warning": 2, "error": 3}

# --- fixed values: schemes that are captured, followed and snapshotted --------
WEB_SCHEMES = ("http", "https")

# --- fixed values: limits -----------------------------------------------------
LINKS_PER_MESSAGE = 100
LOG_FLUSH_BYTES = 500 * 1024
FEED_TAIL = 1000
URLS_PER_JOB = 100

# --- fixed values: media types ------------------------------------------------
JSON_MIME = "application/json"
SCRIPT_MIME = "application/javascript"
PNG_MIME = "image/png"
HTML_MIME = "text/html"

# --- fixed values: browser event names ----------------------------------------
EV_REQUEST = "Network.requestWillBeSent"
EV_RESPONSE = "Network.responseReceived"
EV_FINISHED = "Network.loadingFinished"
EV_FAILED = "Network.loadingFailed"
EV_FRAME_STARTED = "Page.frameStartedLoading"
EV_FRAME_STOPPED = "Page.frameStoppedLoading"
EV_FRAME_NAVIGATED = "Page.frameNavigated"

# --- fixed values: HTML elements without content (HTML standard) --------------
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link",
    "meta", "param", "source", "track", "wbr",
)

# --- fixed values: tags removed from static snapshots -------------------------
SNAPSHOT_STRIPPED_TAGS = ("script", "noscript")

# --- fixed values: HTML event handler attributes ------------------------------
EVENT_ATTRIBUTES = (
    "onabort", "onautocomplete", "onautocompleteerror", "onblur", "oncancel",
    "oncanplay", "oncanplaythrough", "onchange", "onclick", "onclose",
    "oncontextmenu", "oncuechange", "ondblclick", "ondrag", "ondragend",
    "ondragenter", "ondragexit", "ondragleave", "ondragover", "ondragstart",
    "ondrop", "ondurationchange", "onemptied", "onended", "onerror",
    "onfocus", "oninput", "oninvalid", "onkeydown", "onkeypress", "onkeyup",
    "onload", "onloadeddata", "onloadedmetadata", "onloadstart",
    "onmousedown", "onmouseenter", "onmouseleave", "onmousemove",
    "onmouseout", "onmouseover", "onmouseup", "onmousewheel", "onpause",
    "onplay", "onplaying", "onprogress", "onratechange", "onreset",
    "onresize", "onscroll", "onseeked", "onseeking", "onselect", "onshow",
    "onsort", "onstalled", "onsubmit", "onsuspend", "ontimeupdate",
    "ontoggle", "onvolumechange", "onwaiting",
)

# --- fixed values: text stored for a status that has none ----------------------
NO_STATUS_TEXT = "No status text available"

# --- fixed values: context names of the two levels of stats messages -----------
PAGE_CONTEXT = "cli"
CRAWL_CONTEXT = "RecursiveController"

# --- fixed values: meanings of exit codes, by number ---------------------------
EXIT_NAMES = ("ok", "fail", "browser crash", "navigate error")
