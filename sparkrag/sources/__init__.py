"""Readers: files, forum posts, chats, encyclopedia articles, labelled queries."""
