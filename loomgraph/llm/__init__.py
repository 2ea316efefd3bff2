"""Operations for preparing language-model training data.

Nothing outside this folder imports it, so it can be removed as a whole.
Each module holds one operator with a general interface; ``queries`` derives
the registered result tables from the operators.
"""
