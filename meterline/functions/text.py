"""Text rules shared by the operators."""

# The white space that the service's trim() removes and its patterns' \\s matches.
JS_WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
JS_TRIM = f"^{JS_WS}+|{JS_WS}+$"
