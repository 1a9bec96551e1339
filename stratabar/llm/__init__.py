"""Operations for preparing language-model training data at scale.

Ten operators, each in its own module with a general interface, and
``queries`` with the thin table-level queries registered by the entry file.
"""
