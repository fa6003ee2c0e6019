"""Column builders: conversion of raw strings to typed values."""
