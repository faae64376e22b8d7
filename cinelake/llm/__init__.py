"""Operations for training-data pipelines: ten operators, each in a module of its own.

Nothing outside this folder imports it.
"""
