"""Training-data operators: ten distributed jobs over documents, embeddings and chats.

Nothing outside this subpackage imports it.
"""
